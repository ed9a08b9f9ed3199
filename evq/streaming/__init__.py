"""The same operators over unbounded input, where their semantics allow it."""
