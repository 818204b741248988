"""Further registered queries, by area; importing the package registers them."""

from skeinql.entries import models, reads, refusals, shapes, writes

__all__ = ["models", "reads", "refusals", "shapes", "writes"]
