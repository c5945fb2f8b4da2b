"""Where documents come from: files of many formats, and graph tables."""
