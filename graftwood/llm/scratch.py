"""Intermediate tables of the operators: written to the shared folder and read back."""

from __future__ import annotations

from ..streaming.workspace import bounded_batches, materialize, shared_dir

__all__ = ["bounded_batches", "materialize", "shared_dir"]
