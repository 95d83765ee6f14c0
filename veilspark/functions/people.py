"""Names of people, dates of birth and company names: rules that need words and neighbourhoods, not one pattern."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from itertools import takewhile

from veilspark.functions import known, wordlists as W
from veilspark.functions.spans import Span, confidence, trimmed_end


def phrase(words: str) -> str:
    """A pattern for a phrase in any case, whatever the flags of the pattern it becomes part of."""
    made = {" ": "[ \\t]+", "'": "['’]?"}
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else made.get(c) or re.escape(c) for c in words)


def any_phrase(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(phrase(p) for p in sorted(phrases, key=len, reverse=True)) + ")"


# names ------------------------------------------------------------------------------------------------------------

_NAME = rf"({W.NAME_WORD}(?:(?:[ \t]+|(?<=\.)(?=[A-Z])){W.NAME_WORD}){{0,3}})"
_TITLES = "|".join(x for t in W.TITLES for x in (t, t.upper()))
_NAME_RULES = tuple((rule, sure, re.compile(p, re.ASCII)) for rule, sure, p in (
    ("name-title", 0.85, rf"\b(?:{_TITLES})(?:\.[ \t]*|[ \t]+){_NAME}"),
    ("name-field", 0.85, rf"\b{any_phrase(W.NAME_FIELDS)}[ \t]*[:\-–][ \t]*{_NAME}"),
    ("name-relation", 0.85, rf"(?<![A-Za-z]){any_phrase(W.RELATIONS)}[ \t]*[:\-]?[ \t]*{_NAME}"),
    ("name-intro", 0.8, rf"\b{any_phrase(W.INTRODUCTIONS)}[ \t]*[:,-]?[ \t]+{_NAME}"),
    ("name-salutation", 0.75, rf"\b{any_phrase(W.SALUTATIONS)}[ \t]*[:,]?[ \t]+{_NAME}"),
    ("name-signoff", 0.75, rf"\b{any_phrase(W.SIGNOFFS)}[ \t]*,?[ \t]*\r?\n[ \t]*{_NAME}"),
))
#: By rule the words, in small letters, one of which a text has to hold; a title may be any.
_NAME_HINTS = {rule: tuple({p.split()[0].split("'")[0].lower() for p in phrases}) for rule, phrases in (("name-field", W.NAME_FIELDS), ("name-relation", W.RELATIONS), ("name-intro", W.INTRODUCTIONS), ("name-salutation", W.SALUTATIONS), ("name-signoff", W.SIGNOFFS))}
_NAME_STOP, _HEADINGS = set(W.NAME_STOP.split()), set(W.HEADING_WORDS.split())
_WORD = re.compile(W.NAME_WORD)
_FIRST_LINE = re.compile(W.FIRST_LINE)
_NOT_A_PERSON = re.compile(W.NOT_A_PERSON, re.I)
_LETTERS = re.compile("[A-Za-z]+")
FEW_NAMES = 40


def _real(word: str) -> bool:
    """Longer than an initial or an abbreviation, or a short word with a small letter such as "Al"."""
    return len(word) > 2 or len(word) == 2 and word[0].isupper() and word[1].islower() and word.isascii()


def _usable(value: str) -> int:
    """The length of a captured name before its first stop word; 0 if no real word is left."""
    kept = list(takewhile(lambda m: m[0].removesuffix(".").lower() not in _NAME_STOP, _WORD.finditer(value)))
    return kept[-1].end() if any(_real(m[0]) for m in kept) else 0


def names(text: str) -> list[Span]:
    out = []
    if (m := _FIRST_LINE.search(text[:200])) and not any(w.lower() in _NAME_STOP | _HEADINGS for w in re.split(r"[ \t]+", m[1])) and not known.lookup(m[1]):
        out.append(Span(*m.span(1), "Person Name", 0.8, "heuristic", "name-first-line", m[1]))
    folded = text.lower()
    for rule, sure, pattern in _NAME_RULES:
        if rule in _NAME_HINTS and not any(w in folded for w in _NAME_HINTS[rule]):
            continue
        for m in pattern.finditer(text):
            if rule == "name-field" and _NOT_A_PERSON.search(text[max(0, m.start() - 20) : m.start()]):
                continue
            if n := _usable(m[1]):
                out.append(Span(m.start(1), m.start(1) + n, "Person Name", sure, "heuristic", rule, m[1][:n]))
    return out + _repeats(text, out)


def _repeats(text: str, found: list[Span]) -> list[Span]:
    """Other places of the names found so far: whole ones, and their parts. The text is walked once; at each run of
    letters only the names that begin with it are looked at."""
    sure = [s.text for s in found if s.confidence >= 0.75]
    long = {t: [w for w in re.split(r"[ \t]+", t) if len(w) >= 3 and not w.endswith(".")] for t in sure}
    whole = {t for t, ws in long.items() if len(ws) >= 2}
    parts = {w for ws in long.values() for w in ws if w.lower() not in _NAME_STOP}
    by: dict[str, list[str]] = {}
    for needle in sorted(whole, key=len, reverse=True) + sorted(parts - whole, key=len, reverse=True):
        if m := _LETTERS.match(needle):
            by.setdefault(m[0], []).append(needle)
    taken = sorted((s.start, s.end) for s in found)
    hits, free = [], 0
    # of few names the runs are sought, of many all runs are looked up
    runs = _LETTERS if len(by) > FEW_NAMES else re.compile(rf"(?<![A-Za-z])(?:{'|'.join(by)})(?![A-Za-z])")
    for m in runs.finditer(text) if by else ():
        at = m.start()
        if at < free:
            continue
        needle = next((x for x in by.get(m[0], ()) if text.startswith(x, at) and not _LETTERS.match(text, at + len(x))), None)
        if needle:
            free = at + len(needle)
            hits.append(Span(at, free, "Person Name", 0.8 if needle in whole else 0.65, "heuristic", "name-repeat-full" if needle in whole else "name-repeat-part", needle))

    def room(s: Span) -> bool:
        i = bisect_left(taken, (s.start,))
        return (i == len(taken) or taken[i][0] >= s.end) and (not i or taken[i - 1][1] <= s.start)

    out = []
    for s in sorted(hits, key=lambda s: s.start - s.end):
        if room(s):
            insort(taken, (s.start, s.end))
            out.append(s)
    return out


# dates of birth ---------------------------------------------------------------------------------------------------

_DATES = {rule: re.compile(p, flags) for rule, p, flags in W.DATES}
_BIRTH = re.compile(W.BIRTH_WORD, re.I | re.ASCII)
_HINT, _GAP_BEFORE, _GAP_AFTER = re.compile(W.FORMAT_HINT, re.I), re.compile(W.GAP_BEFORE, re.I), re.compile(W.GAP_AFTER)
_BEFORE, _AFTER, _PAD = 45, 15, 40


def _day(x: str) -> bool:
    return 1 <= int(x) <= 31


def _month(x: str) -> bool:
    return 1 <= int(x) <= 12


def _year(x: str) -> bool:
    return len(x) == 2 or 1900 <= int(x) <= 2100


def _date_score(rule: str, m: re.Match) -> float | None:
    if rule == "dob-dmy":
        a, mark, b, y = m[1], m[2], m[3], m[4]
        fits = (_day(a) and _month(b) or _month(a) and _day(b)) and _year(y)
        return (0.85 if mark == "." else 0.94) - 0.08 * (len(y) == 2) if fits else None
    if rule == "dob-ymd":
        return 0.95 if _year(m[1]) and _month(m[3]) and _day(m[4]) else None
    if rule == "dob-month-y":
        return 0.75
    return (0.72 if rule == "dob-d-month" else 0.95) if _day(m[1]) else None


def dates(text: str) -> list[Span]:
    """All dates, the longest of those that overlap, in order."""
    every = [Span(*m.span(), "Person DOB", confidence(c), "regex", rule, m[0]) for rule, p in _DATES.items() for m in p.finditer(text) if (c := _date_score(rule, m))]
    kept: list[Span] = []
    for s in sorted(every, key=lambda s: (s.start - s.end, -s.confidence)):
        if not any(s.start < k.end and s.end > k.start for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def birth_dates(text: str, all_dates: bool = False) -> list[Span]:
    """Dates with a word for a date of birth just before or after; only the neighbourhoods of such words are read."""
    if all_dates:
        return dates(text)
    words = [m.span() for m in _BIRTH.finditer(text)]
    areas: list[list[int]] = []
    for a, z in words:
        a, z = max(0, a - _AFTER - _PAD), min(len(text), z + _BEFORE + _PAD)
        while a and not text[a - 1].isspace():
            a -= 1
        while z < len(text) and not text[z].isspace():
            z += 1
        if areas and a <= areas[-1][1]:
            areas[-1][1] = max(areas[-1][1], z)
        else:
            areas.append([a, z])
    found = [s._replace(start=s.start + a, end=s.end + a) for a, z in areas for s in dates(text[a:z])]
    starts = [s.start for s in found]

    def leads(a: int, z: int) -> bool:
        """Whether text[a:z] may stand between the word and its date."""
        gap = text[a:z]
        return z - a <= _BEFORE and _GAP_BEFORE.search(_HINT.sub(" ", gap)) is not None

    def is_birth(k: int, s: Span) -> bool:
        for a, z in words:
            if z <= s.start and text.count("\n", z, s.start) <= 1 and leads(z, s.start) and not (k and starts[k - 1] >= z):
                return True
            if s.end <= a <= s.end + _AFTER and _GAP_AFTER.search(text[s.end : a]):
                n = bisect_left(starts, z)
                if not (n < len(found) and leads(z, starts[n])):
                    return True
        return False

    return [s for k, s in enumerate(found) if is_birth(k, s)]


# companies --------------------------------------------------------------------------------------------------------

_SUFFIXED = re.compile(rf"(?<![A-Za-z0-9&])(?:{W.COMPANY_WORD}{W.COMPANY_JOIN}){{1,5}}({W.LEGAL}|{W.GENERIC})\.?(?![A-Za-z])", re.ASCII)
#: Without one of these a text has no company: a suffix behind a blank, a field, a bank of somewhere.
_SUFFIX = re.compile(rf"[ \t](?:{W.LEGAL}|{W.GENERIC})\.?(?![A-Za-z])")
_COMPANY_HINTS = tuple({p.split()[0].lower() for p in W.COMPANY_FIELDS})
_LEGAL = re.compile(rf"(?<![A-Za-z]){W.LEGAL}\.?(?![A-Za-z])")
_SUFFIX_WORD = re.compile(rf"^(?:{W.LEGAL}|{W.GENERIC}|Pvt|Private|Pte)\.?\Z")
_COMPANY_FIELD = re.compile(rf"\b{any_phrase(W.COMPANY_FIELDS)}[ \t]*[:\-–][ \t]*({W.COMPANY_WORD}(?:{W.COMPANY_JOIN}{W.COMPANY_WORD}){{0,5}})", re.ASCII)
_FIELD_LEGAL, _BANK_OF, _PRODUCTS = re.compile(rf"(?:^|[ \t]){W.LEGAL}\.?(?=[ \t]|\Z)"), re.compile(W.BANK_OF), re.compile(W.PRODUCTS, re.I)
_FIELDS_OF_WORK, _LEAD = set(W.FIELDS_OF_WORK.split()), set(W.COMPANY_LEAD.split())
_LINK = {"and", "of", "&", "the", "for"}


def _suffixed(text: str, m: re.Match) -> Span | None:
    start, end = m.span()
    for w in re.finditer(r"\S+", m[0]):
        start = m.start() + w.start()
        if w[0].lower() not in _LEAD:
            break
        start = m.start() + w.end()
    value = text[start:end]
    own = [w for w in re.split(r"[ \t]+", value) if w and not _SUFFIX_WORD.search(w) and w not in _LINK]
    legal = _LEGAL.search(value) is not None
    if not own or not legal and (len(own) == 1 and own[0].lower() in _FIELDS_OF_WORK or _PRODUCTS.search(value.strip())):
        return None
    if text[end - 1] == "." and not re.match(r"[ \t]*[a-z,;)]", text[end:]):
        end -= 1
    return Span(start, end, "Business Name", 0.9 if legal else 0.75 if len(own) >= 2 else 0.65, "heuristic", "business-suffix", text[start:end]) if end > start else None


def _fielded(text: str, m: re.Match) -> Span | None:
    start = m.start(1)
    value = text[start : trimmed_end(text, start, m.end(1))]
    stops = [x.end() for x in [_FIELD_LEGAL.search(value)] if x] + [x.start() for x in [re.search(r"\.[ \t]+(?=[A-Z])", value)] if x]
    value = value[: min([len(value), *stops])]
    value = re.sub(r"(?:[ \t]+(?:and|of|&|the|for))+\Z", "", value)
    if value.endswith(".") and not re.search(r"(?:Ltd|Inc|Co|Corp)\.\Z", value):
        value = value[:-1]
    return Span(start, start + len(value), "Business Name", 0.8, "heuristic", "business-field", value) if value else None


def companies(text: str, extra: tuple[str, ...] = ()) -> list[Span]:
    folded = text.lower()
    found = [s for m in _SUFFIXED.finditer(text) if (s := _suffixed(text, m))] if _SUFFIX.search(text) else []
    found += [s for m in _COMPANY_FIELD.finditer(text) if (s := _fielded(text, m))] if any(w in folded for w in _COMPANY_HINTS) else []
    found += [Span(*m.span(), "Business Name", 0.85, "heuristic", "business-bank-of", m[0]) for m in _BANK_OF.finditer(text)] if "Bank" in text else []
    return _unknown(text, found, extra) if found else []


def _unknown(text: str, found: list[Span], extra: tuple[str, ...]) -> list[Span]:
    """Without names of the dictionary, alone or in a list of several."""
    is_known = lambda t: known.lookup(t, extra) is not None
    gone: list[tuple[int, int]] = []
    kept: list[Span] = []
    for s in found:
        cuts = [m.span() for m in re.finditer(r"\s+(?:and|&)\s+", s.text)]
        parts = list(zip([0, *(z for _, z in cuts)], [*(a for a, _ in cuts), len(s.text)]))
        listed = [p for p in parts if is_known(s.text[slice(*p)])]
        if is_known(s.text) or len(listed) == len(parts):
            gone.append((s.start, s.end))
        elif not listed:
            kept.append(s)
        else:
            gone += [(s.start + a, s.start + z) for a, z in listed]
            for a, z in parts:
                if (a, z) not in listed and re.search(r"\s|Ltd|Limited|Inc|LLC|LLP|Corp", s.text[a:z]):
                    kept.append(s._replace(start=s.start + a, end=s.start + z, text=s.text[a:z]))
    inside = gone + [(k.start, k.end) for k in known.find(text, extra)]
    return [s for s in kept if not any(a <= s.start and s.end <= z for a, z in inside) and not any(s.start < z and s.end > a for a, z in gone)]
