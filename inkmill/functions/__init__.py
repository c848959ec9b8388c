"""Column functions: text, layout, edits, metadata and conversation scalars."""
