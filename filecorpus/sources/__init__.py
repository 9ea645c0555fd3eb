"""Sources: file trees, file content, and tables seen as file corpora."""
