"""Texts in another script for the derived inputs of queries, in both engines alike."""

from __future__ import annotations

LATIN, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "कखगघचछजझटठडढणतथदधनपफबभमयरल"


def in_script(text: str) -> str:
    """SQL: a Latin text with a consonant for each letter."""
    return f"translate(lower({text}), '{LATIN}', '{SCRIPT}')"
