"""The registry of structured rules: a pattern, the label it finds, and how sure it is in its context."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from veilspark.functions import checksums
from veilspark.functions import patterns as P
from veilspark.functions.spans import Span, confidence, trimmed_end

_compiled = lru_cache(maxsize=None)(re.compile)


@dataclass(slots=True)
class Hit:
    """A match in its text; context includes the match itself."""

    text: str
    start: int
    end: int
    match: re.Match

    @property
    def value(self) -> str:
        return self.text[self.start : self.end]

    @property
    def digits(self) -> int:
        return sum("0" <= c <= "9" for c in self.value)

    def near(self, pattern: str, before: int) -> bool:
        return _compiled(pattern, P.I).search(self.text[max(0, self.start - before) : self.end]) is not None

    def has(self, pattern: str) -> bool:
        return _compiled(pattern, P.A).search(self.value) is not None

    def line_before(self, n: int) -> str:
        return self.text[max(0, self.start - n) : self.start].rsplit("\n", 1)[-1]


#: None rejects; a pair (end, confidence) also moves the end.
Score = float | Callable[[Hit], "float | tuple[int, float] | None"]


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    pattern: str
    score: Score
    group: int = 0
    trim: bool = False
    flags: int = P.A
    relabel: Callable[[Hit], str] | None = None
    #: A text without this, in any case, holds no match; lets whole documents be passed over.
    needs: str = field(default="")

    def find(self, text: str) -> Iterator[Span]:
        for m in _compiled(self.pattern, self.flags).finditer(text):
            start, end = m.span(self.group)
            if m.start() == m.end() or start < 0:
                continue
            if self.trim:
                end = trimmed_end(text, start, end)
            if end <= start:
                continue
            hit = Hit(text, start, end, m)
            sure = self.score(hit) if callable(self.score) else self.score
            if isinstance(sure, tuple):
                hit.end, sure = sure
            if sure and hit.end > hit.start:
                yield Span(hit.start, hit.end, self.relabel(hit) if self.relabel else self.label, confidence(sure), "regex", self.id, text[hit.start : hit.end])


def within(low: int, high: int, sure: float) -> Score:
    return lambda h: sure if low <= h.digits <= high else None


def near(word: str, before: int, sure: float, otherwise: float | None = None) -> Score:
    return lambda h: sure if h.near(word, before) else otherwise


def only_if(test: Callable[[Hit], bool], sure: float) -> Score:
    return lambda h: sure if test(h) else None


def mixed(h: Hit) -> bool:
    return h.has(r"\d") and h.has(r"[A-Za-z]")


def dummy_domain(domain: str) -> bool:
    d = re.sub(r"[./]+\Z", "", re.sub(r"^www\.", "", domain.lower()))
    return _compiled(P.DUMMY_DOMAIN, P.A).search(d) is not None


def _email(h: Hit) -> float | None:
    local, domain = h.value.split("@")
    if ".." in h.value or dummy_domain(domain):
        return None
    return 0.92 if _role(local) else 0.95 if _free(domain) else 0.8


def _role(local: str) -> bool:
    return _compiled(P.ROLE, P.I).search(local) is not None


def _free(domain: str) -> bool:
    return _compiled(P.FREE_MAIL, P.I).search(domain) is not None


def _email_owner(h: Hit) -> str:
    local, domain = h.value.split("@")
    return "Person Email" if _free(domain) and not _role(local) else "Business Email"


def _phone_owner(fallback: str) -> Callable[[Hit], str]:
    def owner(h: Hit) -> str:
        line = h.line_before(45)
        last = {who: max((m.start() for m in _compiled(p, P.I).finditer(line)), default=-1) for who, p in (("Business Phone No", P.PHONE_BUSINESS), ("Person Phone No", P.PHONE_PERSON))}
        if max(last.values()) < 0:
            return fallback
        return "Business Phone No" if last["Business Phone No"] > last["Person Phone No"] else "Person Phone No"

    return owner


def _keyword_phone(h: Hit) -> float | None:
    shown = len(re.findall(r"[\dXx*•]", h.value, re.ASCII))
    return None if h.digits < 2 or not 8 <= shown <= 13 else 0.85 if h.has("[Xx*•]") else 0.9


def _user_owner(h: Hit) -> str:
    named = _compiled(P.BUSINESS_HANDLE, P.I).search(h.value.removeprefix("@"))
    return "Business Username" if named or _compiled(P.USER_BUSINESS, P.I).search(h.line_before(40)) else "Person Username"


def _user_key(h: Hit) -> float | None:
    after = h.text[h.end : h.end + 3]
    return None if after == "://" or after[:1] in ("@", "/") and after else 0.9 if h.has("[A-Za-z0-9]") else None


def _iban(h: Hit) -> tuple[int, float] | None:
    """The longest beginning that passes; a pattern may run into the next word."""
    end = h.end
    while end - h.start >= 15:
        if checksums.iban(h.text[h.start : end]):
            return end, 0.95
        cut = re.search(r" ?[A-Z0-9]{1,4}\Z", h.text[h.start : end])
        if not cut or not cut.start():
            return None
        end = h.start + cut.start()
    return None


def _masked_account(h: Hit) -> float | None:
    return None if h.near(P.ACCOUNT_PHONE, 30) or h.near(P.ACCOUNT_CARD, 30) else 0.9 if h.near(P.BANK, 40) else 0.7


def _bare_account(h: Hit) -> float | None:
    mobile = len(h.value) == 10 and h.value[0] in "6789"
    return 0.65 if not mobile and not h.near(P.OTHER_ID, 30) and h.near(P.BANK, 40) else None


def _pan(h: Hit) -> float:
    return 0.95 if h.near(P.PAN_WORD, 30) else 0.88 if h.match[2] in P.PAN_HOLDERS else 0.65


def _ifsc(h: Hit) -> float:
    return 0.95 if re.search(r"[0-9]", h.value[5:]) or re.search("ifsc", h.text, re.I) else 0.75


def ipv6_groups(s: str) -> int:
    """How many groups an address spells out; -1 if it is none."""
    halves = s.split("::")
    groups = [g for half in halves for g in (half.split(":") if half or len(halves) == 1 else [])]
    if len(halves) > 2 or not groups or not all(re.fullmatch(r"[0-9A-Fa-f]{1,4}", g) for g in groups):
        return -1
    return len(groups) if (len(groups) == 8 if len(halves) == 1 else len(groups) <= 7) else -1


def _ipv6(h: Hit) -> float | None:
    n, short = ipv6_groups(h.value), "::" in h.value
    return None if n < 0 or not (short or h.has("[a-fA-F]")) else 0.9 if n >= 3 or short else 0.6


def _secret(h: Hit) -> float:
    return 0.9 if h.has(r"\d") or h.has("[A-Z]") and h.has("[a-z]") or len(h.value) >= 20 else 0.6


def _password(h: Hit) -> float | None:
    word, v = h.match[1].lower(), h.value
    if word in ("pin", "mpin", "otp"):
        if not re.fullmatch(r"[0-9]{3,8}", v):
            return 0.6 if h.has(r"\d") else None
        return 0.6 if word.endswith("pin") and len(v) == 6 else 0.9
    if re.search("answer|maiden|memorable", word):
        return 0.85
    return 0.9 if h.has("[^A-Za-z]") or h.has("[a-z]") and h.has("[A-Z]") else 0.6


def _aadhaar(h: Hit) -> float | None:
    if h.near(P.AADHAAR_WORD, 40):
        return 0.95
    if h.near(P.AADHAAR_OTHER, 30) or h.value[0] in "01":
        return None
    return 0.85 if checksums.verhoeff(h.value) else 0.6


def _card(h: Hit) -> float | None:
    d = checksums.digits(h.value)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1:
        return None
    named = h.near(P.CARD_WORD, 40)
    if not named and (h.near(P.CARD_ACCOUNT, 30) or not re.search("[ -]", h.value) and len(d) not in (15, 16)):
        return None
    return 0.95 if checksums.luhn(d) else 0.7 if named else None


def _hex(h: Hit) -> float | None:
    return 0.85 if h.has(r"\d") and h.has("[a-fA-F]") and not h.near(P.TXN_WORD, 30) else None


_STATES, _HANDLES = set(P.LICENSE_STATES.split()), set(P.UPI_HANDLES.split())

#: By detector, in the order that decides between equal detections.
STRUCTURED: dict[str, tuple[Rule, ...]] = {
    "email": (Rule("email-business", "Business Email", P.EMAIL, _email, relabel=_email_owner, needs="@"),),
    "phone": (
        Rule("phone-toll-free", "Business Phone No", P.TOLL_FREE, 0.95),
        Rule("phone-mobile", "Person Phone No", P.MOBILE, within(10, 13, 0.95), relabel=_phone_owner("Person Phone No")),
        Rule("phone-landline", "Business Phone No", P.LANDLINE, within(10, 13, 0.82), relabel=_phone_owner("Business Phone No")),
        Rule("phone-international", "Person Phone No", P.INTERNATIONAL, within(8, 15, 0.86), relabel=_phone_owner("Person Phone No"), needs="+"),
        Rule("phone-masked", "Person Phone No", P.MASKED_PHONE, only_if(lambda h: h.has("[Xx*•]") and h.digits >= 2, 0.8), relabel=_phone_owner("Person Phone No")),
        Rule("phone-keyword", "Person Phone No", P.KEYWORD_PHONE, _keyword_phone, group=1, flags=P.I, relabel=_phone_owner("Person Phone No")),
    ),
    "username": (
        Rule("username-handle", "Person Username", P.HANDLE, 0.85, trim=True, relabel=_user_owner, needs="@"),
        Rule("username-key-value", "Person Username", P.USER_KEY, _user_key, group=1, trim=True, flags=P.I, relabel=_user_owner),
    ),
    "account": (
        Rule("account-iban", "Account Number", P.IBAN, _iban),
        Rule("account-masked", "Account Number", P.MASKED_ACCOUNT, _masked_account),
        Rule("account-keyword", "Account Number", P.ACCOUNT_KEY, lambda h: 0.92 if 8 <= h.digits <= 18 and not h.near(P.ACCOUNT_CARD, 25) else None, group=1, flags=P.I),
        Rule("account-bare-digits", "Account Number", P.BARE_ACCOUNT, _bare_account),
    ),
    "ifsc": (Rule("ifsc", "IFSC Code", P.IFSC, _ifsc),),
    "pan": (Rule("pan", "PAN Card Number", P.PAN, _pan),),
    "address-ip": (
        Rule("ipv4", "IP/MAC Address", P.IPV4, 0.95, needs="."),
        Rule("ipv6", "IP/MAC Address", P.IPV6, _ipv6, needs=":"),
        Rule("mac", "IP/MAC Address", P.MAC, 0.92),
        Rule("mac-dotted", "IP/MAC Address", P.MAC_DOTTED, only_if(lambda h: h.has("[a-fA-F]"), 0.85), needs="."),
    ),
    "key": (
        Rule("key-value", "API/Private Keys", P.SECRET_KEY, _secret, group=2, trim=True, flags=P.I),
        Rule("key-bearer", "API/Private Keys", P.BEARER, 0.95, group=1, needs="bearer"),
        *(Rule(i, "API/Private Keys", p, 0.95) for i, p in P.KNOWN_KEYS),
    ),
    "password": (
        Rule("password-key-value", "Password", P.PASSWORD, _password, group=2, trim=True, flags=P.I),
        Rule("password-otp", "Password", P.OTP, 0.9, group=1, flags=P.I),
    ),
    "aadhaar": (
        Rule("aadhaar-spaced", "Aadhar Card No", P.AADHAAR_SPACED, _aadhaar),
        Rule("aadhaar-plain", "Aadhar Card No", P.AADHAAR_PLAIN, near(P.AADHAAR_WORD, 40, 0.95)),
        Rule("aadhaar-masked", "Aadhar Card No", P.AADHAAR_MASKED, near(P.AADHAAR_WORD, 40, 0.9)),
    ),
    "license": (
        Rule("dl-format", "Driving License No", P.LICENSE, only_if(lambda h: h.match[1] in _STATES, 0.92)),
        Rule("dl-keyword", "Driving License No", P.LICENSE_KEY, within(9, 99, 0.88), group=1, flags=P.I),
    ),
    "voter": (Rule("voter-epic", "Voter ID", P.VOTER, near(P.VOTER_WORD, 40, 0.95, 0.72)),),
    "card": (
        Rule("card-number", "Credit/Debit Card No", P.CARD, _card),
        Rule("card-masked", "Credit/Debit Card No", P.MASKED_CARD, 0.9),
        Rule("card-masked-short", "Credit/Debit Card No", P.MASKED_CARD_SHORT, near(P.CARD_WORD, 30, 0.88)),
        Rule("card-cvv", "Credit/Debit Card No", P.CVV, 0.9, group=1, flags=P.I),
        Rule("card-expiry", "Credit/Debit Card No", P.EXPIRY, near(P.CARD_WORD, 80, 0.88, 0.72), group=1, flags=P.I),
    ),
    "upi": (Rule("upi", "UPI ID", P.UPI, lambda h: 0.95 if h.match[1].lower() in _HANDLES else 0.85 if h.near(P.UPI_WORD, 40) else None, needs="@"),),
    "transaction": (
        Rule("txn-eth", "Transaction ID", P.ETH, 0.95, needs="0x"),
        Rule("txn-keyword", "Transaction ID", P.TXN_KEY, only_if(lambda h: h.has(r"\d"), 0.9), group=1, trim=True, flags=P.I),
    ),
    "invocation": (Rule("invocation-keyword", "Invocation ID", P.INVOCATION_KEY, only_if(mixed, 0.9), group=1, trim=True, flags=P.I, needs="id"),),
    "hash": (
        Rule("ssh-key", "SHA/SSH/Hash Key", P.SSH_KEY, 0.95),
        Rule("hash-prefixed", "SHA/SSH/Hash Key", P.HASH_PREFIXED, 0.95),
        Rule("hash-hex", "SHA/SSH/Hash Key", P.HASH_HEX, _hex),
    ),
    "vpc": (Rule("vpc", "VPC ID", P.VPC, 0.95, needs="vpc-"),),
    "card-id": (
        Rule("card-id", "Card ID", P.CARD_ID, 0.93, needs="_"),
        Rule("card-id-keyword", "Card ID", P.CARD_ID_KEY, only_if(mixed, 0.85), group=1, flags=P.I),
    ),
    "account-id": (
        Rule("account-id-keyword", "Account ID", P.ACCOUNT_ID_KEY, 0.95, group=1, flags=P.I),
        Rule("account-id-arn", "Account ID", P.ARN, 0.95, group=1, needs="arn:aws"),
        Rule("account-id-aws", "Account ID", P.BARE_ACCOUNT_ID, near(P.AWS_WORD, 40, 0.85)),
    ),
}


#: What a text has to hold for a rule to match: one of the words, in any case, and one of the shapes (see _shapes). Whole
#: documents are passed over by it; a rule that isn't here looks at all.
_FOUR, _MASK, _HEX = b"0000", b"MM", b"hh"
HINTS: dict[str, tuple[tuple[str, ...], tuple[bytes, ...]]] = {
    "phone-toll-free": (("1800", "1860"), (b"000",)), "phone-mobile": ((), (b"00000",)), "phone-landline": ((), (_FOUR,)), "phone-masked": ((), (b"ddddd",)),
    "phone-keyword": (("ph", "mob", "tel", "contact", "cell", "whatsapp", "landline", "fax", "helpline"), (b"p" * 8,)),
    "username-key-value": (("user", "log", "screen", "handle", "twitter", "instagram", "github", "gitlab", "linkedin", "telegram", "skype"), ()),
    "account-iban": ((), (b"00",)), "account-masked": ((), (_MASK,)), "account-keyword": (("a/c", "acct", "account"), (b"0",)), "account-bare-digits": ((), (b"0" * 9,)),
    "pan": ((), (_FOUR,)), "ipv4": ((), (b"0.0",)), "mac": ((), (b"hh:hh:hh", b"hh-hh-hh")), "mac-dotted": ((), (b"hhhh.hhhh.hhhh",)),
    "key-value": (("api", "secret", "token", "private", "access"), ()), "key-sk": (("sk-",), ()), "key-stripe": (("_live_", "_test_"), ()), "key-aws": (("akia",), ()),
    "key-github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ()), "key-google": (("aiza",), ()), "key-slack": (("xox",), ()), "key-jwt": (("eyj",), ()),
    "password-key-value": (("pass", "pwd", "pin", "otp", "security", "secret", "memorable", "maiden"), ()),
    "password-otp": (("otp", "one", "verification", "security"), (_FOUR,)),
    "aadhaar-spaced": ((), (b"0000 0000 0000",)), "aadhaar-plain": ((), (b"0" * 12,)), "aadhaar-masked": ((), (b"MMMM",)),
    "dl-format": ((), (b"0" * 7,)), "dl-keyword": (("dl", "d.l.", "licen"), (b"00",)), "voter-epic": ((), (b"0" * 7,)),
    "card-number": ((), (b"0" * 8, b"0000 0000")), "card-masked": ((), (b"MMMM",)), "card-masked-short": ((), (_MASK,)), "card-cvv": (("cvv", "cvc", "cvn", "card"), (b"000",)),
    "card-expiry": (("exp", "valid"), (b"00",)), "txn-keyword": (("tx", "trans", "utr", "rrn", "payment", "bank"), ()),
    "ssh-key": (("ssh-", "ecdsa"), ()), "hash-prefixed": (("sha", "md5"), ()), "hash-hex": ((), (b"h" * 32,)),
    "card-id-keyword": (("card", "token"), ()), "account-id-keyword": (("aws", "account", "cloud", "owner", "payer"), (b"0" * 12,)), "account-id-aws": ((), (b"0" * 12,)),
}


def _table(**classes: str) -> bytes:
    """Each class of characters as one letter (_0 is a digit's), all else as it is."""
    out = bytearray(range(256))
    for letter, chars in classes.items():
        for c in chars.encode():
            out[c] = ord(letter[-1])
    return bytes(out)


_DIGITS, _MASKS = "0123456789", "Xx*?"  # a sign outside ASCII is a ? here and may be a mask
_TABLES = (
    _table(_0=_DIGITS).translate(bytes(32 if c == 45 else c for c in range(256))), _table(M=_MASKS, _0=_DIGITS), _table(d=_DIGITS + _MASKS),
    _table(p=_DIGITS + _MASKS + " \t().-+"), _table(h=_DIGITS + "abcdefABCDEF"),
)


@lru_cache(maxsize=1)
def _shapes(text: str) -> bytes:
    """The text with its digits as 0 and - as a blank; with masks as M; with digits and masks as d, with signs of phone
    numbers as p; with hexadecimal digits as h; one after the other."""
    raw = text.encode("ascii", "replace")
    return b"\n".join(raw.translate(t) for t in _TABLES)


def _may(r: Rule, text: str, folded: str) -> bool:
    words, shapes = HINTS.get(r.id, ((), ()))
    return (not r.needs or r.needs in folded) and (not words or any(w in folded for w in words)) and (not shapes or any(x in _shapes(text) for x in shapes))


def find(detector: str, text: str, folded: str | None = None) -> list[Span]:
    folded = text.lower() if folded is None else folded
    out = [s for r in STRUCTURED[detector] if _may(r, text, folded) for s in r.find(text)]
    return [s._replace(rule="email-personal") if s.label == "Person Email" else s for s in out]
