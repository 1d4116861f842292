"""Flow, label, audit, split, evaluation and model operators."""
