"""Plans over whole documents and pages: what the operators make together."""
