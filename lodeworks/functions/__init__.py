"""Pure Column expressions and pure Python grammars used inside Arrow batches."""
