"""Statement evidence analytics on Spark: relational operators, grammars and plans."""
