"""Driver-side rules: guard, routing, grounding, orchestration, evaluation."""
