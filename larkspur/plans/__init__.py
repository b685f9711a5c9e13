"""From query text to DataFrames: lexer, parser, and the lowering of each kind of statement."""
