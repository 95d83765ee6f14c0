"""The dictionary of names that are public and no personal data. The full list is a parameter: nested JSON of lists,
loaded with veilspark.sources.dictionary; a short one is built in."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import json

from veilspark.functions import wordlists as W

#: Used where no other dictionary is given.
BUILT_IN = json.dumps({
    "top_mncs": {"global_tech": "Google Microsoft Apple Amazon IBM Oracle Intel Cisco Adobe SAP Dell Samsung Sony".split(), "indian_it": "TCS Infosys Wipro HCLTech Zoho Freshworks".split(), "consulting_services": "Accenture Capgemini Cognizant Deloitte".split()},
    "banks": {"public_sector": ["SBI", "Bank of Baroda", "Bank of India"], "private": ["HDFC Bank", "ICICI Bank", "Axis Bank"], "regulators_development": ["RBI"]},
})
_ACRONYMS = {"mncs": "MNCs", "it": "IT", "psus": "PSUs"}
_LEGAL = re.compile(rf"\s+{W.LEGAL_END}\Z", re.I)
_OPENERS = set(W.OPENERS.split())


class Known(NamedTuple):
    start: int
    end: int
    text: str
    name: str
    category: str


def category(path: Iterable[str]) -> str:
    return " · ".join(" ".join(_ACRONYMS.get(w, w[:1].upper() + w[1:]) for w in part.split("_")) for part in path)


def entries(node, path: tuple[str, ...] = ()) -> Iterator[tuple[str, str]]:
    """(name, category) of all leaf lists."""
    if isinstance(node, dict):
        for key, below in node.items():
            yield from entries(below, (*path, key))
    elif isinstance(node, list):
        yield from ((n.strip(), category(path)) for n in node if isinstance(n, str) and n.strip())


def key(name: str | None) -> str:
    """Without up to three legal endings, in lower case, "and" as "&"."""
    t = re.sub(r"[.,]+\Z", "", re.sub(r"\s+", " ", (name or "").replace("’", "'")).strip())
    for _ in range(3):
        cut = _LEGAL.sub("", t).strip()
        if not cut or cut == t:
            break
        t = cut
    return re.sub(r"\s+and\s+", " & ", t.lower())


class Dictionary:
    def __init__(self, names: Iterable[tuple[str, str]]):
        names = list(names)
        self.by_key = {key(n): (n, c) for n, c in names}
        forms = sorted({f for n, _ in names for f in (n, n.upper())}, key=lambda f: (-len(f), f))
        spelled = "|".join(re.escape(f).replace("'", "['’]").replace(r"\ \&\ ", r"\s*(?:&|and)\s*").replace(r"\ &\ ", r"\s*(?:&|and)\s*").replace(r"\ ", r"\s+") for f in forms)
        self.pattern = re.compile(rf"(?<![^\W_])(?:{spelled})(?:\s+{W.LEGAL_END})*(?![^\W_])") if forms else None

    def find(self, text: str) -> list[Known]:
        out = []
        for m in self.pattern.finditer(text) if self.pattern else ():
            if (e := self.by_key.get(key(m[0]))) and not self._surname(text, m.start(), e[0]):
                out.append(Known(*m.span(), m[0], *e))
        return out

    @staticmethod
    def _surname(text: str, start: int, name: str) -> bool:
        """One word behind another capitalised one is rather a person's, unless that one opens a phrase."""
        before = re.search(r"([^\W\d_]+)\s+\Z", text[max(0, start - 40) : start])
        word = before[1] if before else ""
        tail = re.search(r"[A-ZÀ-ÖØ-Þ][^\W\d_A-ZÀ-ÖØ-Þ]+\Z", word)
        return " " not in name and tail is not None and tail[0].lower() not in _OPENERS

    def lookup(self, text: str) -> tuple[str, str] | None:
        if hit := self.by_key.get(key(text)):
            return hit
        found = self.find(text)
        whole = len(found) == 1 and found[0].start == 0 and found[0].end == len(text.strip())
        return (found[0].name, found[0].category) if whole else None


@lru_cache(maxsize=8)
def dictionary(source: str = BUILT_IN, extra: tuple[str, ...] = ()) -> Dictionary:
    return Dictionary([*entries(json.loads(source)), *((n, category(("organisation_list",))) for n in extra)])


_current: list[str] = [BUILT_IN]


def use(source: str) -> None:
    """The dictionary of this process from here on, as JSON text; kernels set it first in their workers."""
    _current[0] = source


def current() -> str:
    return _current[0]


def lookup(text: str, extra: tuple[str, ...] = ()) -> tuple[str, str] | None:
    return dictionary(_current[0], extra).lookup(text)


def find(text: str, extra: tuple[str, ...] = ()) -> list[Known]:
    return dictionary(_current[0], extra).find(text)
