"""The query language: lexer, parser, and the compiler to DataFrames."""
