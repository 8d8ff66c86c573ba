"""A scanner for hidden content and prompt injection in tables of pages, documents and conversations."""
