"""Is a replacement the same kind of data, and does it read like real text? Column expressions, evaluated in the JVM.

FIXED VALUES: the patterns and word lists are given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATES = (
    r"^\d{1,2}[\/.-]\d{1,2}[\/.-](?:\d{4}|\d{2})\z", r"^\d{4}[\/.-]\d{1,2}[\/.-]\d{1,2}\z",
    rf"(?i)^\d{{1,2}}(?:st|nd|rd|th)?(?:\s+of)?[\s-]+{_MONTH}\.?,?[\s-]+(?:\d{{4}}|'\d{{2}})\z",
    rf"(?i)^{_MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\z", rf"(?i)^{_MONTH}\.?,?\s+\d{{4}}\z",
)
_ADDRESS_WORD = r"(?i)(?<![A-Za-z0-9_])(?:road|rd|street|st|nagar|layout|cross|main|sector|block|lane|colony|apartment|apartments|apt|flat|floor|tower|society|marg|avenue|ave|village|district|phase|stage|plot|house|building|city|pin)(?![A-Za-z0-9_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\z"
DIGIT_LABELS = ("Person Phone No", "Business Phone No", "Account Number", "Credit/Debit Card No", "Aadhar Card No", "Account ID")
_PLACEHOLDER = r"^[\[<{(].*[\]>})]\z"
_MASK = r"^[xX*#•_?\-]{2,}\z|^(?:[xX*#•]{2,}[\s-]?)+\d{0,4}\z"
_JUNK = r"(?i)^(?:redacted|removed|masked|hidden|anonymi[sz]ed|n\/?a|null|none|undefined|nan|unknown|test|dummy|sample|placeholder|lorem ipsum.*|asdf\w*|qwerty\w*|xyz|abc|tbd|todo|\?+)\z"


def _digits(t: Column) -> Column:
    return F.regexp_count(t, F.lit("[0-9]"))


def _any(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _ipv6(t: Column) -> Column:
    """Eight groups, or at most seven around one '::'."""
    group = "[0-9A-Fa-f]{1,4}"
    halves = F.split(t, "::", -1)
    side = rf"^(?:{group}(?::{group})*)?\z"
    n = F.aggregate(F.filter(F.split(F.regexp_replace(t, "::", ":"), ":"), lambda g: g != ""), F.lit(0), lambda s, _: s + 1)
    return t.rlike(rf"^{group}(?::{group}){{7}}\z") | ((F.size(halves) == 2) & F.get(halves, F.lit(0)).rlike(side) & F.get(halves, F.lit(1)).rlike(side) & n.between(1, 7))


def same_type(label: Column, text: Column) -> Column:
    """Whether text is of the label's kind; an unknown label accepts all."""
    t = F.trim(F.coalesce(text, F.lit("")))
    n = _digits(t)
    token = lambda k: t.rlike(rf"^\S{{{k},}}\z") & t.rlike("[A-Za-z0-9]")
    email, user = t.rlike(_EMAIL), t.rlike(r"^@?[A-Za-z0-9_.\-]{2,40}\z")
    phone = t.rlike(r"^[+0-9][0-9\s().-]*[0-9]\z") & n.between(7, 15)
    address = (F.size(F.split(t, r"\s+")) >= 2) & _any(n > 0, t.rlike(_ADDRESS_WORD), t.contains(","))
    kinds = {
        "Person Name": t.rlike(r"^\p{L}[\p{L}.'’ -]{0,79}\z") & (F.size(F.split(t, r"\s+")) <= 6),
        "Person Email": email, "Business Email": email, "Person Phone No": phone, "Business Phone No": phone, "Person Username": user, "Business Username": user,
        "Person Address": address, "Business Address": address, "Person DOB": _any(*(t.rlike(d) for d in _DATES)),
        "Business Name": t.rlike(r"^[\p{L}0-9&.,'’() -]{2,100}\z") & t.rlike(r"\p{L}"),
        "Account Number": t.rlike(r"^[A-Za-z0-9 -]{6,34}\z") & (n >= 6), "IFSC Code": t.rlike(r"(?i)^[A-Z]{4}0[A-Z0-9]{6}\z"), "PAN Card Number": t.rlike(r"(?i)^[A-Z]{5}\d{4}[A-Z]\z"),
        "IP/MAC Address": _any(t.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z"), _ipv6(t), t.rlike(r"^[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}\z")),
        "API/Private Keys": token(8), "Password": token(3), "Transaction ID": token(8), "Invocation ID": token(8), "Aadhar Card No": t.rlike(r"^\d{4}[ -]?\d{4}[ -]?\d{4}\z"),
        "Driving License No": t.rlike(r"(?i)^[A-Z]{2}[ -]?\d{2}[ -]?[A-Z0-9 -]{8,14}\z") & (n >= 9), "Voter ID": t.rlike(r"(?i)^[A-Z]{3}\d{7}\z"),
        "Credit/Debit Card No": _any(t.rlike(r"^[0-9 -]{13,23}\z") & (n >= 13), t.rlike(r"^\d{3,4}\z"), t.rlike(r"^\d{2}\s*\/\s*\d{2,4}\z")),
        "UPI ID": t.rlike(r"^[A-Za-z0-9_.\-]{2,}@[A-Za-z][A-Za-z0-9]{1,30}\z"), "SHA/SSH/Hash Key": _any(t.rlike(r"(?i)^[0-9a-f]{32,128}\z"), t.rlike(r"^(?:ssh-|ecdsa-)\S+\s+\S{20,}")),
        "VPC ID": t.rlike(r"^vpc-[0-9a-f]{8,17}\z"), "Card ID": t.rlike(r"^[a-z]+_[A-Za-z0-9]{8,}\z"), "Account ID": t.rlike(r"^\d{12}\z"),
    }
    chosen = reduce(lambda case, kind: case.when(label == kind[0], kind[1]), kinds.items(), F)
    return F.coalesce(chosen.otherwise(True), F.lit(True))


def not_sensible(text: Column) -> Column:
    """Why a replacement is not real text; null if it is."""
    t = F.trim(F.coalesce(text, F.lit("")))
    quoted = lambda why: F.concat(F.lit('"'), t, F.lit(f'" {why}'))
    return (
        F.when(t == "", F.lit("the PII was deleted instead of being replaced"))
        .when(t.rlike(_PLACEHOLDER), quoted("is a placeholder, not realistic text"))
        .when(t.rlike(_MASK), quoted("is masked, not realistic text"))
        .when(t.rlike(_JUNK), quoted("is not a realistic value"))
        .when(F.regexp_replace(t, "[0-9]", "").rlike(r"(.)\1{3,}"), quoted("repeats the same character"))
        .when(t.rlike(r"\p{L}{6,}") & ~t.rlike("[aeiouyAEIOUYÀ-ɏऀ-෿]"), quoted("looks like random letters"))
    )


def digits_kept(label: Column, original: Column, replacement: Column) -> Column:
    """Five digits or more that a number keeps at its beginning, or four at its end; of the last ten."""
    o, r = (F.substring(d, F.greatest(F.length(d) - 9, F.lit(1)), F.lit(10)) for d in (F.regexp_replace(original, "[^0-9]", ""), F.regexp_replace(replacement, "[^0-9]", "")))
    n = F.length(o)

    def run(a: Column, b: Column) -> Column:
        """How many characters a and b have in common from the first on."""
        place = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        return F.aggregate(place, F.lit(0), lambda s, i: F.when((s == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(s))

    p = run(o, r)
    q = F.least(run(F.reverse(o), F.reverse(r)), n - p)
    able = label.isin(*DIGIT_LABELS) & (n >= 8) & (F.length(r) == n) & (o != r)
    return F.when(able & (p >= 5), F.substring(o, F.lit(1), p)).when(able & (q >= 4), F.substring(o, n - q + 1, q))


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def short(text: Column) -> Column:
    """One line of at most 80 characters."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > 80, F.concat(F.substring(t, 1, 79), F.lit("…"))).otherwise(t)
