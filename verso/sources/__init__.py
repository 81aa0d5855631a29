"""Sources and sinks: test tables, EPUB files, script files, generated books, WAV data."""
