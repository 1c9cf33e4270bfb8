"""Registered queries."""

from . import account, deliver, describe, exchange
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "account", "deliver", "describe", "exchange"]
