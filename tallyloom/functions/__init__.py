"""Column functions: answers, texts, divergences, checkers, losses."""
