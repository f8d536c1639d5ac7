"""Replay-trajectory analytics on Spark.

Tables of recorded trajectories (prompt, response, behaviour-policy NLL,
advantage, origin label) go in; templated, tokenised, batched and scored tables,
off-policy losses and batch metrics come out. Every operator takes and returns a
DataFrame, so the pieces compose with ordinary Spark code.
"""

from trajloom.options import BatchOptions, LossOptions, TokenOptions

__all__ = ["BatchOptions", "LossOptions", "TokenOptions"]
