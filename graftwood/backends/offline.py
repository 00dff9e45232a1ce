"""Deterministic stand-in for a model: summaries by patterns, functions scored on the five dimensions."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

from ..schema import WEIGHTS
from .base import Answer

_DEF = re.compile(r"^[ \t]*(?:(?:pub|export|public|private|protected|static|async|final|inline|func|function|def|fn|void|int|const)\s+)+\*?([A-Za-z_]\w*)\s*\(([^)]*)\)", re.M)
_IMPORT = re.compile(r"^\s*(?:import|from|use|#include|require)\s+[\"'<]?([\w./]+)", re.M)
_WORD = re.compile(r"[A-Za-z_]\w{2,}")
_BODY = re.compile(r"```\n(.*?)\n```", re.S)


def functions_of(code: str) -> list[dict]:
    """Functions with their places; a function ends where the next begins."""
    found = list(_DEF.finditer(code))
    out = []
    for k, m in enumerate(found):
        end = found[k + 1].start() if k + 1 < len(found) else len(code)
        start = code.count("\n", 0, m.start(1)) + 1
        body = code[m.start() : end].rstrip()
        out.append({"name": m[1], "args": m[2], "body": body, "start": start, "end": start + body.count("\n")})
    return out


def _overlap(a: str, b: str) -> float:
    x, y = set(_WORD.findall(a)), set(_WORD.findall(b))
    return len(x & y) / len(x | y) if x | y else 0.0


def compare(code_a: str, code_b: str, threshold: int) -> list[dict]:
    out = []
    for f in functions_of(code_a):
        for g in functions_of(code_b):
            scores = {
                "data_structure": _overlap(f["body"], g["body"]),
                "function_signature": SequenceMatcher(None, f["args"], g["args"]).ratio(),
                "algorithm_logic": SequenceMatcher(None, f["body"].split(), g["body"].split()).ratio(),
                "naming_convention": SequenceMatcher(None, f["name"], g["name"]).ratio(),
                "protocol_conformance": float((f["args"] == "") == (g["args"] == "")),
            }
            scores = {k: round(100 * v) for k, v in scores.items()}
            total = sum(scores[k] * w for k, w in WEIGHTS.items())
            if total >= threshold:
                level = "high" if total > 60 else "medium" if total >= 40 else "low" if total >= 20 else "very_low"
                side = lambda x: {"name": x["name"], "line_start": x["start"], "line_end": x["end"]}
                out.append({"func_a": side(f), "func_b": side(g), "scores": scores, "composite_score": int(total), "similarity_level": level, "analysis": "by patterns"})
    return out


class OfflineBackend:
    """Answers every kind but directory matching, where the heuristic takes over."""

    def __init__(self, threshold: int = 20) -> None:
        self.threshold = threshold

    def ask(self, kind: str, system: str, user: str, max_tokens: int) -> Answer:
        if kind == "dir_match":
            return Answer(None, 0, "offline")
        if kind == "func_compare":
            bodies = _BODY.findall(user)
            value: dict = {"similar_functions": compare(*bodies[:2], self.threshold) if len(bodies) >= 2 else []}
        else:
            words = sorted(set(_WORD.findall(user)))[:60]
            names = [f["name"] for f in functions_of(user)]
            field = "exports" if kind == "file_summary" else "key_exports"
            value = {"purpose": " ".join(words), field: names, "frameworks": [], "patterns": sorted(set(_IMPORT.findall(user)))[:20]}
            value |= {"imports": value["patterns"], "key_snippets": []} if kind == "file_summary" else {"children_overview": ""}
        return Answer(json.dumps(value, ensure_ascii=False), 1, None)
