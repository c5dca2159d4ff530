"""The registered queries of the evaluation operators and their SQL."""

from __future__ import annotations

from colloquy.plans import alignment, assertions, report, retrieval, speech, streams, texts

_MODULES = (speech, report, alignment, retrieval, texts, assertions, streams)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.Q.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
