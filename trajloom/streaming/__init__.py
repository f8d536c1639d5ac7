"""The same operators on a replay feed."""
