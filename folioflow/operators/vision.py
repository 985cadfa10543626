"""Replies of a vision model: layout elements, page Markdown, image regions and equations. The calls themselves are not made here."""

from __future__ import annotations

import json
import math
import re
from functools import cmp_to_key
from typing import Any


#: Entities in the order in which they are decoded, and patterns of garbled formulas.
ENTITIES = (("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"))
_LOST = r"[\ufffd\ue000-\uf8ff]"
GARBLED = (rf"[A-Za-z()\[\]]*{_LOST}[A-Za-z0-9\s()+=\-]*{_LOST}?[A-Za-z0-9()=\-]*", r"[A-Za-z][>@][A-Za-z\s]*", "[A-Za-z]+\\s*[><=@]\\s*[A-Za-z\ufffd]+")
#: Defaults of an element's height by kind.
HEIGHTS = {"headline": 30, "image": 100, "paragraph": 50}


def clean(text: str) -> str:
    text = re.sub(r"</?(point_box|collection)[^>]*>", "", text)
    for entity, char in ENTITIES:
        text = text.replace(entity, char)
    return " ".join(text.split())


def _array(reply: str | None) -> list[dict[str, Any]]:
    """The JSON array of objects in a reply, without what follows the last whole object of one that was cut off; else nothing."""
    text = reply or ""
    start, end = text.find("["), text.rfind("]")
    if start < 0:
        return []
    text = text[start : end + 1] if end > start else text[start : text.rfind("}") + 1] + "]"
    try:
        found = json.loads(text)
    except ValueError:
        return []
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def elements(headlines: str | None, images: str | None, paragraphs: str | None) -> list[dict[str, Any]]:
    """Elements of three replies. Images at one place count once; paragraphs at the height of a headline are left out."""
    out: list[dict[str, Any]] = []
    places = set()
    for kind, reply in (("headline", headlines), ("image", images), ("paragraph", paragraphs)):
        for item in _array(reply):
            y, x = item.get("top") or item.get("y") or 0, item.get("left") or item.get("x") or 0
            if kind == "image":
                if (x, y) in places:
                    continue
                places.add((x, y))
            if kind == "paragraph" and any(e["type"] == "headline" and abs(e["y"] - y) < 20 for e in out):
                continue
            said = (item.get("description") or item.get("text")) if kind == "image" else (item.get("text") or item.get("content"))
            out.append({"type": kind, "content": clean(said or ""), "y": y, "x": x, "width": item.get("width") or 100, "height": item.get("height") or HEIGHTS[kind]})
    return out


def reading_order(found: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """From top to bottom, and from left to right within 30 of height."""
    return sorted(found, key=cmp_to_key(lambda a, b: a["y"] - b["y"] if abs(a["y"] - b["y"]) > 30 else a["x"] - b["x"]))


def distinct(found: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The first of elements whose first 50 letters and digits are the same."""
    first: dict[str, dict[str, Any]] = {}
    for e in found:
        first.setdefault(re.sub("[^a-z0-9]", "", e["content"].lower())[:50], e)
    return list(first.values())


def to_markdown(found: list[dict[str, Any]]) -> str:
    out, last = [], None
    for e in found:
        text = e["content"]
        out += [""] if last not in (None, e["type"]) else []
        out += {"headline": [f"{'#' if e['height'] > 40 or e['y'] < 100 else '##'} {text}"], "subheadline": [f"### {text}"], "image": [f"![{text}](image)", f"*{text}*"], "citation": [f"> {text}"]}.get(e["type"], [text])
        last = e["type"]
    return "\n\n".join(out)


def page(headlines: str | None, images: str | None, paragraphs: str | None) -> str:
    return to_markdown(distinct(reading_order(elements(headlines, images, paragraphs))))


def image_regions(reply: str | None, page_width: float = 800, page_height: float = 1100) -> list[dict[str, Any]]:
    """Photographs of a reply, with their bounds as shares of the page; null where no place is given."""
    out = []
    for i in _array(reply):
        placed = i.get("x") is not None and i.get("y") is not None
        bounds = {"x": i["x"] / page_width, "y": i["y"] / page_height, "width": (i.get("w") or i.get("width") or 150) / page_width, "height": (i.get("h") or i.get("height") or 150) / page_height} if placed else None
        out.append({"description": i.get("photo") or i.get("desc") or i.get("description") or "", "after": i.get("section") or i.get("headline") or "", "bounds": bounds})
    return out


def crop(bounds: dict[str, float] | None, width: int, height: int) -> tuple[int, int, int, int] | None:
    """Pixels of a region on a canvas: x, y, width, height; none for one of 20 or less either way."""
    if bounds is None:
        return None
    x, w = max(0, min(math.floor(bounds["x"] * width), width - 1)), math.floor(bounds["width"] * width)
    y, h = max(0, min(math.floor(bounds["y"] * height), height - 1)), math.floor(bounds["height"] * height)
    w, h = min(w, width - x), min(h, height - y)
    return (x, y, w, h) if w > 20 and h > 20 else None


def equations(reply: str | None) -> list[str]:
    """Lines of a reply that are formulas: with a dollar sign or a command, and no talk about them."""
    text = (reply or "").strip()
    if text == "NONE" or len(text) < 5:
        return []
    talk = lambda t: "here are" in t.lower() or "found" in t.lower() or ("equation" in t.lower() and "$" not in t)
    return [t for x in text.split("\n") if (t := x.strip()) and not talk(t) and ("$" in t or "\\" in t)]


def with_equations(text: str, found: list[str], keep_rest: bool = True) -> str:
    """Garbled stretches replaced by the equations in turn. Those left over follow the first heading, or come first."""
    left = list(found)
    for pattern in GARBLED:
        for stretch in [m.group() for m in re.finditer(pattern, text)] if left else ():
            if left:
                text = text.replace(stretch, left.pop(0), 1)
    if not left or not keep_rest:
        return text
    block, heading = "\n\n".join(left), re.search(r"^#+\s+[^\n]+\n", text, re.M)
    return f"{text[: heading.end()]}\n\n{block}\n\n{text[heading.end() :]}" if heading else f"{block}\n\n{text}"


def with_images(text: str, images: list[dict[str, Any]], pictures: dict[int, str]) -> tuple[str, list[dict[str, Any]]]:
    """The text with references to the extracted pictures after its first heading (or at the end), and those pictures. Where none
    is usable, the images' descriptions follow the first heading."""
    if not images:
        return text, []
    safe = lambda t: re.sub(r"([\[\]()])", r"\\\1", t).replace("\n", " ").strip()[:200]
    good = [(i, x, pictures[i]) for i, x in enumerate(images) if pictures.get(i, "").startswith("data:image/") and len(pictures[i]) >= 100]
    named = [{"id": f"img_{i}", "data_url": url, "description": x["description"] or f"Image {i + 1}"} for i, x, url in good]
    shown = [s for p in named for s in (f"![{safe(p['description'])}](#{p['id']})", f"*{safe(p['description'])}*")] or [f"*[Image: {safe(x['description'] or 'Image')}]*" for x in images]
    parts = [p.strip() for p in re.split(r"\n\n+", text) if p.strip()]
    at = next((i + 1 for i, p in enumerate(parts) if re.match(r"#{1,3}\s", p)), len(parts) if named else None)
    return "\n\n".join(parts if at is None else [*parts[:at], *shown, *parts[at:]]), named
