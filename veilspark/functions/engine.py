"""All detectors over one text, and the choice among what overlaps."""

from __future__ import annotations

from collections.abc import Callable

from veilspark.functions import addresses, people, rules
from veilspark.functions.spans import Span, resolved

#: In the order that decides between equal detections.
DETECTORS = (
    "name", "email", "phone", "date", "username", "address", "business", "account", "ifsc", "pan", "address-ip", "key", "password", "aadhaar",
    "license", "voter", "card", "upi", "transaction", "invocation", "hash", "vpc", "card-id", "account-id",
)
_OWN: dict[str, Callable[[str], list[Span]]] = {"name": people.names, "date": people.birth_dates, "address": addresses.addresses, "business": people.companies}


def register(name: str, find: Callable[[str], list[Span]]) -> None:
    """A detector of one's own, after all others; workers need it too, so a module registers it when imported."""
    global DETECTORS
    _OWN[name] = find
    DETECTORS = (*DETECTORS, name)


def every(text: str, only: tuple[str, ...] | None = None, all_dates: bool = False, strict: bool = False) -> list[Span]:
    """What the detectors find, before a choice; one that fails finds nothing and warns, or ends the job if strict."""
    out: list[Span] = []
    folded = text.lower()
    for name in DETECTORS:
        if only is not None and name not in only:
            continue
        try:
            found = people.birth_dates(text, True) if name == "date" and all_dates else _OWN[name](text) if name in _OWN else rules.find(name, text, folded)
        except Exception as e:  # noqa: BLE001
            if strict:
                raise RuntimeError(f"detector {name} failed") from e
            import warnings

            warnings.warn(f"detector {name} failed: {e}", stacklevel=2)
            continue
        out += [s for s in found if 0 <= s.start < s.end <= len(text)]
    return out


def detect(text: str | None, only: tuple[str, ...] | None = None, all_dates: bool = False, strict: bool = False) -> list[Span]:
    return resolved(every(text, only, all_dates, strict), text) if text else []
