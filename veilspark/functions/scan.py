"""Matches of a pattern with their offsets and surroundings, and the structured rules, as column expressions.

Spark's regular expressions give values, not places. Here one replacement puts a mark around every match, a split at
the marks leaves what lies outside and inside by turns, and sums of lengths are the places. Sums run in blocks, so that
a text of many matches costs little more than a short one, and what stands before a match is put together from the ends
of the pieces before it, never cut out of the whole text. Marks are characters that Unicode reserves for such use; a text
that has them is read with another character in their place.

Nothing here leaves the JVM. `\\b` is spelled out for ASCII, which is how the rules mean it. Expressions are built as SQL
text (sqltext)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from veilspark.functions import checksums, rules
from veilspark.functions import patterns as P
from veilspark.functions import sqltext as F
from veilspark.functions.sqltext import X as Column

_CUT, _FIELD, _OTHER = "\ufdd0", "\ufdd1", "\ufffd"
#: Characters before a match that rules may ask for, and pieces that hold as many: no match is shorter than 3 characters.
BEFORE, _PIECES = 96, 64
_BLOCK = 64
_WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str) -> str:
    return pattern.replace("\\Z", "\\z").replace(r"\b", _WORD_EDGE)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts_of(lengths: Column) -> Column:
    """For an array of lengths where each begins: sums of those before, by blocks."""
    summed = lambda values, of: F.aggregate(
        values, F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a")),
        lambda acc, x: F.struct((acc["s"] + of(x)).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    own = F.transform(blocks, lambda b: summed(b, lambda x: x))
    return let(own, lambda o: let(summed(o, lambda x: x["s"])["a"], lambda base: F.flatten(F.transform(o, lambda x, i: F.transform(x["a"], lambda at: at + F.get(base, i))))))


def clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _CUT + _FIELD, _OTHER * 2)


def marked(text: Column, pattern: str, groups: tuple[int, ...] = ()) -> Column:
    """Clean text with marks around every match of a Java pattern, its groups asked for behind it."""
    return F.regexp_replace(text, pattern, _CUT + "$0" + "".join(f"{_FIELD}${g}" for g in groups) + _CUT)


def matches(marked: Column) -> Column:
    """All matches in marked text: (start, whole, g: the groups asked for, before, after)."""

    def placed(pieces: Column) -> Column:
        every = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.substring_index(p, _FIELD, 1)))

        def found(own: Column) -> Column:
            ends = F.transform(own, lambda p: F.right(p, BEFORE))

            def one(starts: Column, last: Column, k: Column) -> Column:
                at = 2 * k
                before = F.right(F.array_join(F.slice(last, F.greatest(1, at - _PIECES), F.least(_PIECES, at - 1)), ""), BEFORE)
                after = F.left(F.array_join(F.transform(F.slice(own, at + 1, 4), lambda p: F.left(p, 3)), ""), 3)
                return F.struct(
                    F.get(starts, at - 1).alias("start"), F.get(own, at - 1).alias("whole"), F.slice(F.split(F.get(pieces, at - 1), _FIELD, -1), 2, 9).alias("g"),
                    before.alias("before"), after.alias("after"),
                )

            return let(starts_of(F.transform(own, lambda p: F.length(p))), lambda s: let(ends, lambda e: F.transform(F.sequence(1, ((F.size(own) - 1) / 2).cast("int")), lambda k: one(s, e, k))))

        return F.when(F.size(pieces) >= 3, let(every, found))

    return let(F.split(marked, _CUT, -1), placed)


@dataclass
class Match:
    """A match inside an expression: its value may be a group that ends the match but for `rest` characters."""

    m: Column
    value: Column
    prefix: Column
    text: Column

    def group(self, k: int) -> Column:
        return F.get(self.m["g"], k)

    def digits(self) -> Column:
        return F.regexp_count(self.value, F.lit("[0-9]"))

    def has(self, pattern: str) -> Column:
        return self.value.rlike(java(pattern))

    def before(self, n: int) -> Column:
        return F.right(F.concat(self.m["before"], self.prefix), F.lit(n))

    def near(self, pattern: str, before: int) -> Column:
        return F.concat(self.before(before), self.value).rlike("(?i)" + java(pattern))

    def line_before(self, n: int) -> Column:
        return F.substring_index(self.before(n), "\n", -1)


@dataclass(frozen=True)
class Rule:
    """A rule of the registry as an expression: how sure it is (null rejects), which label it gives, and what it needs of a match."""

    sure: Callable[[Match], Column]
    label: Callable[[Match], Column] | None = None
    groups: tuple[int, ...] = ()
    value: int | None = None
    rest: int = 0
    pattern: str = ""
    whole: Callable[[Column], Column] | None = None
    #: A text is scanned only if it holds one of these, in any case, and the run of digits named (RUNS): which no match lacks.
    needs: tuple[str, ...] = ()
    run: str = ""


def _lit(x: float) -> Callable[[Match], Column]:
    return lambda m: F.lit(x)


def _within(low: int, high: int, sure: float):
    return lambda m: F.when(m.digits().between(low, high), sure)


def _near(word: str, n: int, sure: float, otherwise: float | None = None):
    return lambda m: F.when(m.near(word, n), sure).otherwise(F.lit(otherwise).cast("double"))


def _domain(m: Match) -> Column:
    return F.substring_index(m.value, "@", -1)


def _role(m: Match) -> Column:
    return F.substring_index(m.value, "@", 1).rlike("(?i)" + java(P.ROLE))


def _free(m: Match) -> Column:
    return _domain(m).rlike("(?i)" + java(P.FREE_MAIL))


def _email(m: Match) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(_domain(m)), r"^www\.", ""), r"[./]+\z", "")
    dummy = m.value.contains("..") | plain.rlike(java(P.DUMMY_DOMAIN))
    return F.when(dummy, F.lit(None).cast("double")).when(_role(m), 0.92).when(_free(m), 0.95).otherwise(0.8)


def _email_owner(m: Match) -> Column:
    return F.when(_free(m) & ~_role(m), "Person Email").otherwise("Business Email")


def _phone_owner(fallback: str):
    def owner(m: Match) -> Column:
        def nearest(line: Column) -> Column:
            last = lambda p: F.when(line.rlike("(?i)" + java(p)), F.length(F.regexp_extract(line, "(?is)^(.*)" + java(p), 1))).otherwise(-1)
            return F.when(last(P.PHONE_BUSINESS) > last(P.PHONE_PERSON), "Business Phone No").when(last(P.PHONE_PERSON) >= 0, "Person Phone No").otherwise(fallback)

        return let(m.line_before(45), nearest)

    return owner


def _keyword_phone(m: Match) -> Column:
    shown = F.regexp_count(m.value, F.lit("[0-9Xx*•]"))
    return F.when((m.digits() >= 2) & shown.between(8, 13), F.when(m.has("[Xx*•]"), 0.85).otherwise(0.9))


def _user_owner(m: Match) -> Column:
    named = F.regexp_replace(m.value, "^@", "").rlike("(?i)" + java(P.BUSINESS_HANDLE)) | m.line_before(40).rlike("(?i)" + java(P.USER_BUSINESS))
    return F.when(named, "Business Username").otherwise("Person Username")


def _user_key(m: Match) -> Column:
    # what trimming took off stands after the value
    after = F.left(F.concat(F.substr(F.get(m.m["g"], 0), F.length(m.value) + 1), m.m["after"]), F.lit(3))
    return F.when((after != "://") & ~after.rlike("^[@/]") & m.has("[A-Za-z0-9]"), 0.9)


def _iban(value: Column) -> Column:
    """The longest beginning that passes, or nothing."""
    shorter = F.aggregate(F.sequence(F.lit(1), F.lit(14)), value, lambda v, _: F.when(checksums.iban_column(v, F) | (F.length(v) < 15), v).otherwise(F.regexp_replace(v, r" ?[A-Z0-9]{1,4}\z", "")))
    return let(shorter, lambda v: F.when((F.length(v) >= 15) & checksums.iban_column(v, F), v).otherwise(""))


def _masked_account(m: Match) -> Column:
    return F.when(~m.near(P.ACCOUNT_PHONE, 30) & ~m.near(P.ACCOUNT_CARD, 30), F.when(m.near(P.BANK, 40), 0.9).otherwise(0.7))


def _bare_account(m: Match) -> Column:
    mobile = (F.length(m.value) == 10) & m.value.rlike("^[6-9]")
    return F.when(~mobile & ~m.near(P.OTHER_ID, 30) & m.near(P.BANK, 40), 0.65)


def _ipv6(m: Match) -> Column:
    h = "[0-9A-Fa-f]{1,4}"
    n, short = F.size(F.filter(F.split(m.value, ":"), lambda x: x != "")), m.value.contains("::")
    valid = F.when(short, m.value.rlike(f"^(?:{h}(?::{h})*)?::(?:{h}(?::{h})*)?$") & n.between(1, 7)).otherwise(m.value.rlike(f"^{h}(?::{h}){{7}}$"))
    return F.when(valid & (short | m.has("[a-fA-F]")), F.when((n >= 3) | short, 0.9).otherwise(0.6))


def _secret(m: Match) -> Column:
    return F.when(m.has("[0-9]") | (m.has("[A-Z]") & m.has("[a-z]")) | (F.length(m.value) >= 20), 0.9).otherwise(0.6)


def _password(m: Match) -> Column:
    word = F.lower(m.group(1))
    pin = F.when(~m.value.rlike("^[0-9]{3,8}$"), F.when(m.has("[0-9]"), 0.6)).when(word.endswith("pin") & (F.length(m.value) == 6), 0.6).otherwise(0.9)
    plain = F.when(m.has("[^A-Za-z]") | (m.has("[a-z]") & m.has("[A-Z]")), 0.9).otherwise(0.6)
    return F.when(word.isin("pin", "mpin", "otp"), pin).when(word.rlike("answer|maiden|memorable"), 0.85).otherwise(plain)


def _aadhaar(m: Match) -> Column:
    other = m.near(P.AADHAAR_OTHER, 30) | m.value.rlike("^[01]")
    return F.when(m.near(P.AADHAAR_WORD, 40), 0.95).when(other, F.lit(None).cast("double")).when(checksums.verhoeff_column(m.value, F), 0.85).otherwise(0.6)


def _card(m: Match) -> Column:
    d, named = F.regexp_replace(m.value, "[^0-9]", ""), m.near(P.CARD_WORD, 40)
    fit = F.length(d).between(13, 19) & ~d.rlike(r"^([0-9])\1*$")
    alone = ~m.near(P.CARD_ACCOUNT, 30) & (m.value.rlike("[ -]") | F.length(d).isin(15, 16))
    return F.when(fit & (named | alone), F.when(checksums.luhn_column(d, F), 0.95).when(named, 0.7))


def _mixed(sure: float):
    return lambda m: F.when(m.has("[0-9]") & m.has("[A-Za-z]"), sure)


def _if(pattern: str, sure: float):
    return lambda m: F.when(m.has(pattern), sure)


_STATES, _HANDLES = P.LICENSE_STATES.split(), P.UPI_HANDLES.split()
_MASK = "[Xx*•]"
#: What a text has to hold for each of the known kinds of keys.
_KNOWN = {
    "key-sk": ("sk-",), "key-stripe": ("_live_", "_test_"), "key-aws": ("akia",), "key-github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "key-google": ("aiza",),
    "key-slack": ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), "key-jwt": ("eyj",), "key-private": ("-----begin",),
}
#: Runs that are looked for once in a text.
RUNS = {"d1": "[0-9]", "d2": "[0-9]{2}", "d3": "[0-9]{3}", "d4": "[0-9]{4}", "hex": "[0-9A-Fa-f]{32}"}
#: By id of the registry's rule. Patterns, labels and trimming are the registry's, but for two patterns which say the
#: same without nested repetition, on which Java recurses.
RULES: dict[str, Rule] = {
    "email-business": Rule(_email, _email_owner, needs=("@",)),
    "phone-toll-free": Rule(_lit(0.95), run="d3"),
    "phone-mobile": Rule(_within(10, 13, 0.95), _phone_owner("Person Phone No"), run="d4"),
    "phone-landline": Rule(_within(10, 13, 0.82), _phone_owner("Business Phone No"), run="d4"),
    "phone-international": Rule(_within(8, 15, 0.86), _phone_owner("Person Phone No"), needs=("+",), run="d1"),
    "phone-masked": Rule(lambda m: F.when(m.has(_MASK) & (m.digits() >= 2), 0.8), _phone_owner("Person Phone No"), run="d1"),
    "phone-keyword": Rule(_keyword_phone, _phone_owner("Person Phone No"), (1,), 0, needs=("ph", "mob", "tel", "contact", "cell", "whatsapp", "landline", "fax", "helpline"), run="d1"),
    "username-handle": Rule(_lit(0.85), _user_owner, needs=("@",)),
    "username-key-value": Rule(_user_key, _user_owner, (1,), 0, needs=("user", "log", "screen", "handle", "twitter", "instagram", "git", "linkedin", "telegram", "skype")),
    "account-iban": Rule(_lit(0.95), whole=_iban, run="d2"),
    "account-masked": Rule(_masked_account, pattern=rf"(?<![\w*•]){_MASK}{{2,}}+(?:[ -]{_MASK}{{2,}}+)*+[ -]?\d{{3,6}}(?!\w)", run="d3"),
    "account-keyword": Rule(lambda m: F.when(m.digits().between(8, 18) & ~m.near(P.ACCOUNT_CARD, 25), 0.92), None, (1,), 0, needs=("a/c", "acct", "account"), run="d1"),
    "account-bare-digits": Rule(_bare_account, run="d4"),
    "ifsc": Rule(lambda m: F.when(F.substr(m.value, F.lit(6)).rlike("[0-9]") | m.text.rlike("(?i)ifsc"), 0.95).otherwise(0.75), needs=("0",)),
    "pan": Rule(lambda m: F.when(m.near(P.PAN_WORD, 30), 0.95).when(m.group(0).isin(*P.PAN_HOLDERS), 0.88).otherwise(0.65), None, (2,), run="d4"),
    "ipv4": Rule(_lit(0.95), needs=(".",), run="d1"),
    "ipv6": Rule(_ipv6, needs=(":",)),
    "mac": Rule(_lit(0.92), needs=(":", "-")),
    "mac-dotted": Rule(_if("[a-fA-F]", 0.85), needs=(".",)),
    "key-value": Rule(_secret, None, (2,), 0, needs=("key", "secret", "token")),
    "key-bearer": Rule(_lit(0.95), None, (1,), 0, needs=("bearer",)),
    **{i: Rule(_lit(0.95), needs=w) for i, w in _KNOWN.items()},
    "password-key-value": Rule(_password, None, (2, 1), 0, needs=("pass", "pwd", "pin", "otp", "security", "secret", "memorable", "mother")),
    "password-otp": Rule(_lit(0.9), None, (1,), 0, needs=("otp", "one", "verification", "security"), run="d4"),
    "aadhaar-spaced": Rule(_aadhaar, run="d4"),
    "aadhaar-plain": Rule(_near(P.AADHAAR_WORD, 40, 0.95), run="d4"),
    "aadhaar-masked": Rule(_near(P.AADHAAR_WORD, 40, 0.9), run="d4"),
    "dl-format": Rule(lambda m: F.when(m.group(0).isin(*_STATES), 0.92), None, (1,), run="d4"),
    "dl-keyword": Rule(_within(9, 99, 0.88), None, (1,), 0, needs=("dl", "d.l.", "licen"), run="d2"),
    "voter-epic": Rule(_near(P.VOTER_WORD, 40, 0.95, 0.72), run="d4"),
    "card-number": Rule(_card, run="d4"),
    "card-masked": Rule(_lit(0.9), run="d4"),
    "card-masked-short": Rule(_near(P.CARD_WORD, 30, 0.88), run="d4"),
    "card-cvv": Rule(_lit(0.9), None, (1,), 0, needs=("cvv", "cvc", "cvn", "verification"), run="d3"),
    "card-expiry": Rule(_near(P.CARD_WORD, 80, 0.88, 0.72), None, (1,), 0, needs=("exp", "valid"), run="d2"),
    "upi": Rule(lambda m: F.when(F.lower(m.group(0)).isin(*_HANDLES), 0.95).when(m.near(P.UPI_WORD, 40), 0.85), None, (1,), needs=("@",)),
    "txn-eth": Rule(_lit(0.95), needs=("0x",), run="hex"),
    "txn-keyword": Rule(_if("[0-9]", 0.9), None, (1,), 0, needs=("tx", "trans", "utr", "rrn", "ref"), run="d1"),
    "invocation-keyword": Rule(_mixed(0.9), None, (1,), 0, needs=("id",), run="d1"),
    "ssh-key": Rule(_lit(0.95), needs=("ssh-", "ecdsa-")),
    "hash-prefixed": Rule(_lit(0.95), needs=("sha", "md5"), run="hex"),
    "hash-hex": Rule(lambda m: F.when(m.has("[0-9]") & m.has("[a-fA-F]") & ~m.near(P.TXN_WORD, 30), 0.85), run="hex"),
    "vpc": Rule(_lit(0.95), needs=("vpc-",)),
    "card-id": Rule(_lit(0.93), needs=("_",)),
    "card-id-keyword": Rule(_mixed(0.85), None, (1,), 0, needs=("card", "token"), run="d1"),
    "account-id-keyword": Rule(_lit(0.95), None, (1,), 0, needs=("aws", "account", "cloud", "owner", "payer"), run="d4"),
    "account-id-arn": Rule(_lit(0.95), None, (1,), 0, rest=1, needs=("arn:aws",), run="d4"),
    "account-id-aws": Rule(_near(P.AWS_WORD, 40, 0.85), needs=("aws", "amazon", "iam", "arn", "cloud"), run="d4"),
}

_TRAIL = r"[.,;:!?'\"\]}>»”’)]"


def trimmed(value: Column) -> Column:
    """Without trailing punctuation and closing brackets that nothing opened."""
    n = F.length(F.regexp_extract(value, _TRAIL + r"+\z", 0))
    count = lambda v, c: F.length(v) - F.length(F.replace(v, F.lit(c), F.lit("")))
    step = lambda v, _: F.when(v.endswith(")") & (count(v, "(") >= count(v, ")")) | ~v.rlike(_TRAIL + r"\z"), v).otherwise(F.left(v, F.length(v) - 1))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), value, step)).otherwise(value)


def found(text: Column, hits: Column, rule: rules.Rule, number: int) -> Column:
    """What a rule of the registry makes of its matches in clean text: (start, end, label, confidence, number, rule, text)."""
    own = RULES[rule.id]

    def each(m: Column) -> Column:
        value = m["whole"] if own.value is None else F.get(m["g"], own.value)
        full = F.length(value)
        if rule.trim:
            value = trimmed(value)
        if own.whole:
            value = own.whole(value)

        def judged(v: Column) -> Column:
            prefix = F.left(m["whole"], F.length(m["whole"]) - full - own.rest)
            one = Match(m, v, prefix, text)
            start = m["start"] + (F.length(m["whole"]) - full - own.rest if own.value is not None else F.lit(0))
            label = own.label(one) if own.label else F.lit(rule.label)

            def named(label: Column) -> Column:
                name = F.when(label == "Person Email", "email-personal").otherwise(rule.id) if own.label else F.lit(rule.id)
                return F.struct(
                    start.alias("start"), (start + F.length(v)).alias("end"), label.alias("label"), own.sure(one).cast("double").alias("confidence"),
                    F.lit(number).alias("number"), name.alias("rule"), v.alias("text"),
                )

            return let(label, named)

        return let(value, judged)

    return F.filter(F.transform(hits, each), lambda s: s["confidence"].isNotNull() & (s["end"] > s["start"]))


def every(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """What all rules (of the detectors named) find in a text, before a choice; null entries are filtered."""
    numbered = [(d, r, n) for n, (d, r) in enumerate((d, r) for d, own in rules.STRUCTURED.items() for r in own)]
    taken = [(r, n) for d, r, n in numbered if only is None or d in only]

    def run(t: Column) -> Column:
        def read(seen: Column) -> Column:
            texts = []
            for r, _ in taken:
                own = RULES[r.id]
                one = marked(t, ("(?i)" if r.flags == P.I else "") + java(own.pattern or r.pattern), own.groups)
                gate = reduce(or_, (seen["folded"].contains(w) for w in own.needs)) if own.needs else None
                if own.run:
                    gate = seen[own.run] if gate is None else gate & seen[own.run]
                texts.append(one if gate is None else F.when(gate, one).otherwise(""))
            hits = F.transform(F.array(*texts), lambda m: matches(m))
            return let(hits, lambda h: F.flatten(F.filter(F.array(*(found(t, F.get(h, k), r, n) for k, (r, n) in enumerate(taken))), lambda a: a.isNotNull())))

        return let(F.struct(F.lower(t).alias("folded"), *(t.rlike(p).alias(k) for k, p in RUNS.items())), read)

    return let(clean(text), run)
