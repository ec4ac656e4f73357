"""Registered queries and the SQL that checks them."""

from corpusguard.plans.queries import QUERIES
from corpusguard.plans.sql import SQL

__all__ = ["QUERIES", "SQL"]
