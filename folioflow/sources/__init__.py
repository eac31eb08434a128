"""Reading and writing: stored documents, catalogue tables, merged output."""
