"""Where pages come from: tables of raw or captured pages, and the web."""
