"""Registered queries of the privacy-incident operators."""

from __future__ import annotations

from importlib import import_module
from pathlib import Path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _file in sorted(Path(__file__).parent.glob("q_*.py")):
    _m = import_module(f".{_file.stem}", __package__)
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
