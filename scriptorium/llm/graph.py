"""Connected components, as the core has them."""

from __future__ import annotations

from ..operators.components import ROUNDS, components  # noqa: F401  for the operators
