"""Queries; importing the package registers them."""

from sparkloom.plans import core, further, more, solving  # noqa: F401
