"""Registered queries; importing the package registers all of them in catalog."""

from . import catalog, history, stores  # noqa: F401
