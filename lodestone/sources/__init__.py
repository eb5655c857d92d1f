"""Sources: documents and recorded streams to rows."""
