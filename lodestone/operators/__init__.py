"""DataFrame to DataFrame operators: chunking, embedding, storage, search, change detection, rendering."""
