"""Writers. Each one says how rows are spread over tasks and files."""
