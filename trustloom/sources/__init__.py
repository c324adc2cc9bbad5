"""Where records come from: files, folders, repositories, transcripts, queues, logs, servers."""
