"""Jobs: feature blocks, summaries, preparation, evaluation, models."""
