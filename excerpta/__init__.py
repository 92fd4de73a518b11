"""excerpta: document content extraction and corpus preparation as Spark queries."""
