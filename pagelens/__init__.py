"""Web-page analytics on Spark: URL, HTML, text, ranking, decision and crawl-replay operators as DataFrame transforms."""
