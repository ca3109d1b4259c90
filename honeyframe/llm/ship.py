"""The package for Python workers of a session that did not bring it."""

from __future__ import annotations

from honeyframe.session import ship

__all__ = ["ship"]
