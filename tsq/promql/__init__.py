"""The query language: parser and syntax tree."""
