"""Where entries, documents and versions come from and go to."""
