"""Aho-Corasick automata of broadcast entries, each built once in a worker, however many tasks the worker runs."""

from __future__ import annotations

from collections.abc import Mapping

_built: dict[str, object] = {}


def automaton(key: str, entries: Mapping[str, object]):
    """The automaton of entries (text to what it reports), which key stands for; a worker keeps the last one. None without entries."""
    import ahocorasick

    if key not in _built:
        made = ahocorasick.Automaton() if entries else None
        for text, value in entries.items():
            made.add_word(text, value)
        if entries:
            made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]
