"""Values planted in the texts of documents, and what all structured rules together have to find there.

A row's text keeps all it has: a sentence of the case that its id chooses stands before or behind it, a filler away, so
that the surroundings of one don't reach into the other. The SQL states the planted detections from the case, and those
that a text has of its own (addresses, card numbers, secrets and international numbers) by patterns of its own dialect,
with offsets by splitting; it repeats no step of the operator. Expressions are SQL that Spark and DuckDB read alike; n is
the id."""

from __future__ import annotations

from veilspark import made
from veilspark.functions.language import STOP_WORDS
from veilspark.functions.patterns import LABELS
from veilspark.functions.wordlists import ADDRESS_STOP, NAME_STOP, TITLES
from veilspark.made import HEX, N3, N4, N5, N6, N7, N, quoted

FILLER = "repeat('. ', 60)"
IP, MAIL, CARD, KEY, ACC, PHONE = "IP/MAC Address", "Person Email", "Credit/Debit Card No", "API/Private Keys", "Account Number", "Person Phone No"
_USER = f"'user' || {N}"

#: Each case: plain text, or (value, label, rule, confidence) for what has to be found of all rules at once.
CASES: list[list[str | tuple[str, str, str, float]]] = [
    ["'Write to '", (f"{_USER} || '@gmail.com'", MAIL, "email-personal", 0.95), "' now'"],
    ["'Write to '", (f"{_USER} || '@acmeworks.in'", "Business Email", "email-business", 0.8), "' now'"],
    ["'Write to '", (f"'sales@firm' || {N} || '.com'", "Business Email", "email-business", 0.92), "'.'"],
    ["'Write to user' || " + N + " || '@mail.example.com or to a..b@gmail.com now'"],
    ["'Call my mobile '", (f"'98765' || {N5}", PHONE, "phone-mobile", 0.95), "' today'"],
    ["'Toll free '", (f"'1800 123 ' || {N4}", "Business Phone No", "phone-toll-free", 0.95), "' today'"],
    ["'The office line is '", (f"'+44 20 7946 ' || {N4}", "Business Phone No", "phone-international", 0.86), "' today'"],
    ["'office, '", (f"'+91 98765 ' || {N5}", "Business Phone No", "phone-mobile", 0.95), "' or my '", (f"'+91 98765 ' || {N5}", PHONE, "phone-mobile", 0.95)],
    ["'Ping '", (f"'@ravi' || {N}", "Person Username", "username-handle", 0.85), "'. please'"],
    ["'Follow the company '", (f"'@ravi' || {N}", "Business Username", "username-handle", 0.85), "' and log in with username: '", (f"'ravi' || {N}", "Person Username", "username-key-value", 0.9)],
    ["'Account number: '", (f"'1234' || {N7}", ACC, "account-keyword", 0.92), "' closed'"],
    ["'Account number: '", ("'4111 1111 1111 1111'", ACC, "account-keyword", 0.92), "' is longer than its card' || " + N],
    ["'savings '", (f"'XXXX' || {N4}", ACC, "account-masked", 0.9), "' closed'"],
    ["'the bank said '", (f"'123456' || {N7}", ACC, "account-bare-digits", 0.65), "' closed'"],
    ["'order 123456' || " + N7 + " || ' came'"],
    ["'IBAN '", ("'GB82 WEST 1234 5698 7654 32'", ACC, "account-iban", 0.95), "' AND' || " + N3 + " || ' more'"],
    ["'IFSC '", (f"'HDFC0' || {N6}", "IFSC Code", "ifsc", 0.95), "' here, not HDFC1' || " + N6],
    ["'PAN '", (f"'ABCPK' || {N4} || 'L'", "PAN Card Number", "pan", 0.95), "' here'"],
    ["'part '", (f"'ABZPK' || {N4} || 'L'", "PAN Card Number", "pan", 0.88), "' and '", (f"'ABCDK' || {N4} || 'L'", "PAN Card Number", "pan", 0.65)],
    ["'host '", (f"'10.1.' || cast(n % 256 as string) || '.' || cast(n % 199 as string)", IP, "ipv4", 0.95), "', '", ("'192.168.0.1'", IP, "ipv4", 0.95), "' and '", (f"'2001:db8::' || cast(n % 9999 as string)", IP, "ipv6", 0.9), "' up, version 1.2.' || " + N],
    ["'at '", (f"'00:1a:2b:3c:4d:' || lpad(cast(n % 100 as string), 2, '0')", IP, "mac", 0.92), "' up, '", (f"'00aa.2b3c.' || {N4}", IP, "mac-dotted", 0.85), "' too'"],
    ["'api_key='", (f"'Ab' || {HEX}", KEY, "key-value", 0.9), "'. Authorization: Bearer '", (HEX, KEY, "key-bearer", 0.95), "' sent'"],
    ["'SECRET = '", (f"'AKIA' || lpad({N}, 16, '0')", KEY, "key-aws", 0.95), "' kept'"],
    ["'password: '", (f"'token=Zx9' || {HEX}", "Password", "password-key-value", 0.9), "')'"],
    ["'Your verification code came: '", (f"'4' || {N4}", "Password", "password-otp", 0.9), "' today'"],
    ["'mpin: '", (f"{N6}", "Password", "password-key-value", 0.6), "' or pin is '", (f"{N4}", "Password", "password-key-value", 0.9)],
    ["'Aadhaar '", (f"'2345 6789 ' || {N4}", "Aadhar Card No", "aadhaar-spaced", 0.95), "' seen'"],
    ["'aadhaar '", (f"'XXXX XXXX ' || {N4}", CARD, "card-masked", 0.9), "' seen'"],
    ["'permit '", (f"'KA01 2011 ' || {N7}", "Driving License No", "dl-format", 0.92), "' seen'"],
    ["'Voter '", (f"'ABC' || {N7}", "Voter ID", "voter-epic", 0.95), "' seen'"],
    ["'code '", (f"'ABC' || {N7}", "Voter ID", "voter-epic", 0.72), "' seen'"],
    ["'Visa card '", ("'4111 1111 1111 1111'", CARD, "card-number", 0.95), "' cvv '", (f"{N3}", CARD, "card-cvv", 0.9), "', exp '", ("'12/27'", CARD, "card-expiry", 0.88)],
    ["'Visa card '", ("'4111-1111-1111-1112'", CARD, "card-number", 0.7), "' or '", (f"'XXXX XXXX XXXX ' || {N4}", CARD, "card-masked", 0.9)],
    ["'one '", ("'4111 1111 1111'", "Aadhar Card No", "aadhaar-spaced", 0.6), "' 1112 only' || " + N],
    ["'pay '", (f"'ravi' || {N} || '@okaxis'", "UPI ID", "upi", 0.95), "', or '", (f"{_USER} || '@gmail.com'", MAIL, "email-personal", 0.95), "' or ravi@randombank'"],
    ["'Txn ID: '", (f"'TX' || lpad({N}, 10, '0')", "Transaction ID", "txn-keyword", 0.9), "'. done'"],
    ["'hash '", (f"'0x' || {HEX} || {HEX}", "Transaction ID", "txn-eth", 0.95), "' done, 0x' || " + HEX],
    ["'Invocation ID: '", (f"'a1' || {HEX}", "Invocation ID", "invocation-keyword", 0.9), "' ran'"],
    ["'digest '", (f"'9a' || substring({HEX}, 1, 30)", "SHA/SSH/Hash Key", "hash-hex", 0.85), "' kept and '", (f"'sha256:' || {HEX} || {HEX}", "SHA/SSH/Hash Key", "hash-prefixed", 0.95)],
    ["'in '", (f"'vpc-' || substring({HEX}, 1, 8)", "VPC ID", "vpc", 0.95), "' up, vpc-' || substring(" + HEX + ", 1, 9)"],
    ["'object '", (f"'tok_' || {HEX}", "Card ID", "card-id", 0.93), "' kept'"],
    ["'AWS account '", (f"'123456' || {N6}", "Account ID", "account-id-keyword", 0.95), "' owns arn:aws:s3:eu:'", (f"'123456' || {N6}", "Account ID", "account-id-arn", 0.95), "':bucket'"],
    ["'Nothing of row ' || " + N + " || ' is told here (see above).'"],
]


#: Sentences for the detectors of words, beside those of CASES whose structured values no other rule takes.
WORDS: list[list[str | tuple[str, str, str, float]]] = [
    ["'yesterday Mr. '", (made._PERSON, "Person Name", "name-title", 0.85), "' called us'"],
    ["'Date of birth: '", ("'0' || cast(1 + n % 9 as string) || '/0' || cast(1 + n % 7 as string) || '/19' || cast(70 + n % 30 as string)", "Person DOB", "dob-dmy", 0.94), "' as told'"],
    ["'Address: '", ("'Flat ' || cast(1 + n % 90 as string) || ', 4th Cross Road, Indiranagar, Bengaluru 560038'", "Person Address", "address-5-signals", 0.9), "'; then'"],
    ["'he works at '", (f"{made._COMPANY} || ' Technologies Pvt Ltd'", "Business Name", "business-suffix", 0.9), "' now'"],
]
EVERYTHING = WORDS + CASES


def _value(piece) -> str:
    return piece if isinstance(piece, str) else piece[0]


def sentence(cases: list | None = None) -> str:
    return made.cases([" || ".join(f"({_value(p)})" for p in case) for case in cases or CASES])


FIRST = "floor(n / 7) % 2 = 1"
#: Detectors of which SQL can't say what texts have of their own.
PARTLY = ("date", "address", "business")


def around(said: str) -> str:
    """The text of a row with a sentence before or behind it."""
    return f"case when {FIRST} then {said} || {FILLER} || t else t || {FILLER} || {said} end"


#: What texts have of their own, in DuckDB's dialect: rule, label, confidence, pattern (before)(value)(after), condition.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LUHN = "(select sum(case when k % 2 = 0 then d when d > 4 then 2 * d - 9 else 2 * d end) from (select unnest(list_transform(string_split(reverse(regexp_replace(value, '[^0-9]', '', 'g')), ''), lambda x: x::int)) as d, unnest(range(length(regexp_replace(value, '[^0-9]', '', 'g')))) as k)) % 10 = 0"
def _listed(words: str) -> str:
    return ", ".join(quoted(w) for w in words.split())


_TITLES = "|".join(x for t in TITLES for x in (t, t.upper()))
OWN = {
    "address-ip": ("ipv4", IP, 0.95, rf"(^|[^\w.])((?:{_OCTET}\.){{3}}{_OCTET})($|[^\w.]|\.$|\.[^\d])", "true"),
    "card": ("card-number", CARD, 0.95, r"(^|[^\w-])(\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})($|[^\w-])", f"length(regexp_replace(value, '[^0-9]', '', 'g')) in (15, 16) and {_LUHN}"),
    "key": ("key-value", KEY, 0.9, r"((?i:\b(?:api[_ \t-]?key|secret|token)\b)[\"'']?[ \t]*[:=][ \t]*[\"'']?)([^\s,;\"'']{8,})()", "true"),
    "phone": ("phone-international", PHONE, 0.86, r"(^|[^\w+])(\+(?:[0-8]|9[02-9]|9\s)\d{0,2}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4})($|[^\d])", "length(regexp_replace(value, '[^0-9]', '', 'g')) between 8 and 15"),
    "name": ("name-title", "Person Name", 0.85, rf"((?:^|[^A-Za-z0-9_])(?:{_TITLES})(?:\.[ \t]*|[ \t]+))([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+){{0,3}})()", f"length(value) > 1 and lower(split_part(value, ' ', 1)) not in ({_listed(NAME_STOP)})"),
    "address": ("address-1-signals", "Person Address", 0.5, r"(^|\s)(St\. [A-Z][^\s,;:.\-–/&)\"”’]*)()", f"lower(split_part(value, ' ', 2)) not in ({_listed(ADDRESS_STOP)})"),
    "hash": ("hash-hex", "SHA/SSH/Hash Key", 0.85, r"(^|[^0-9a-zA-Z_])([0-9a-f]{128}|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40})($|[^0-9a-zA-Z_])", "regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-fA-F]')"),
}


def own_sql(kinds: tuple[str, ...]) -> str:
    """(n, start, end, label, confidence, rule, text) of what texts t have of their own; shift is what stands before them."""
    parts = []
    for kind in kinds:
        rule, label, sure, pattern, condition = OWN[kind]
        # two numbers that share the blank between them: a character of no width of its own lets both have a boundary
        t = r"regexp_replace(t, '(\d{13,}) ', '\1 ' || chr(64977), 'g')" if kind == "card" else "t"
        split = f"string_split(regexp_replace({t}, '{pattern}', '\\1' || chr(64976) || '\\2' || chr(64976) || '\\3', 'g'), chr(64976))"
        each = f"select n, shift, parts[k] as value, coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(replace(x, chr(64977), '')))), 0)::bigint as place from (select n, shift, parts, unnest(range(2, len(parts) + 1, 2)) as k from (select n, shift, {split} as parts from placed))"
        parts.append(f"select n, (shift + place)::int as start, (shift + place + length(value))::int as \"end\", {quoted(label)} as label, {sure}::double as confidence, {quoted(rule)} as rule, value as text from ({each}) where {condition}")
    return " union all ".join(parts)


DOCUMENTS = "select doc_id as n, coalesce(text, '') as t from documents"
CONVERSATIONS = "select conv_id * 100 + turn as n, coalesce(text, '') as t from conversations"


def placed_sql(said: str, source: str = DOCUMENTS) -> str:
    return f"d as ({source}), placed as (select *, case when {FIRST} then length(said) + 120 else 0 end as shift, case when {FIRST} then 0 else length(t) + 120 end as said_at from (select *, {said} as said from d))"


def all_sql(cases: list | None = None, own: tuple[str, ...] = ("address-ip", "card", "key", "phone"), source: str = DOCUMENTS, name: str = "doc_id") -> str:
    """What all rules find in texts with their planted sentences, and what they have of their own."""
    cases, parts = cases or CASES, []
    for k, case in enumerate(cases):
        at = "said_at"
        for p in case:
            if not isinstance(p, str):
                parts.append(f"select n, ({at})::int as start, ({at} + length({p[0]}))::int as \"end\", {quoted(p[1])} as label, {p[3]}::double as confidence, {quoted(p[2])} as rule, {p[0]} as text from placed where n % {len(cases)} = {k}")
            at += f" + length({_value(p)})"
    return f"with {placed_sql(sentence(cases), source)} select n as {name}, start, \"end\", label, confidence, rule, text from ({own_sql(own)} union all {' union all '.join(parts)})"


def one_sql(detector: str) -> str:
    """What one detector finds in documents with a sentence of made.DETECTED; for those of PARTLY in the sentence alone."""
    cases = made.DETECTED[detector]
    parts = [
        f"select n, (said_at + {len(a)})::int as start, (said_at + {len(a)} + length({v}))::int as \"end\", {quoted(label)} as label, {v} as text from placed where n % {len(cases)} = {k}"
        for k, (a, v, _, label) in enumerate(cases) if label
    ]
    if detector in OWN and detector not in PARTLY:
        parts.append(f"select n, start, \"end\", label, text from ({own_sql((detector,))})")
    return f"with {placed_sql(made.text_of(detector))} select n as doc, start, \"end\", label, text from ({' union all '.join(parts)})"


# pairs of texts -----------------------------------------------------------------------------------------------------

#: What conversations have of their own, by all detectors.
ALL_KINDS = ("address-ip", "card", "key", "phone", "name", "address")
_GROUP = {name: group for name, group in LABELS}


def _grouped(label: str) -> str:
    return "case " + label + " " + " ".join(f"when '{n}' then '{g}'" for n, g in _GROUP.items() if g) + " end"


def _pairs_sql(said: str) -> str:
    """placed, and own: what the left texts have of their own."""
    return f"with {placed_sql(said, CONVERSATIONS)}, own as ({own_sql(ALL_KINDS)})"


def compared_sql() -> str:
    """Findings of stage one: those of the sentence, and that nothing is labelled of what texts have of their own."""
    own = "select n as pair_id, case when confidence >= 0.7 then 'MISSED' else 'NEEDS_REVIEW' end as category, label, null::varchar as right_label, start as left_start, \"end\" as left_end, start as right_start, \"end\" as right_end from own"
    return f"{_pairs_sql(made.compared_text())} {made.compared_sql('placed', 'said_at + ')} union all {own}"


def asked_sql() -> str:
    own = f"select n as pair_id, {_grouped('label')} || '_TODO' as category, {_grouped('label')} as \"group\", 'unlabeled' as status, case when confidence >= 0.7 then 'yes' else 'unsure' end as suggest from own"
    return f"{_pairs_sql(made.compared_text())} {made.asked_sql('placed')} union all {own}"


def label_counts_sql(labels: list[str]) -> str:
    own = "select n as pair_id, label, count(*)::bigint as detected, 0::bigint as labeled from own group by all"
    return f"{_pairs_sql(made.compared_text())} select pair_id, label, sum(detected)::bigint as detected, sum(labeled)::bigint as labeled from ({made.label_counts_sql(labels, 'placed')} union all {own}) group by all"


LEFT_SAID, RIGHT_SAID = (made.cases([c[k] for c in made.VERIFIED]) for k in (0, 1))


_OTHERS = [k for k in STOP_WORDS if k != "English"]


def _foreign_sql() -> str:
    """n of the left texts that have a line, or a sentence of a long one, in another language than English."""
    hits = ", ".join(f"len(list_intersect(w, [{', '.join(quoted(x) for x in dict.fromkeys(words.split()))}])) as {k}" for k, words in STOP_WORDS.items())
    most = f"greatest({', '.join(_OTHERS)})"
    return f"""select distinct n from (select *, {hits} from (select n, list_distinct(w) as w, len(w) as c from (select n, u, regexp_extract_all(lower(u), '\\p{{L}}{{2,}}') as w from
 (select n, unnest(case when length(v) > 400 then regexp_extract_all(v, '[^.!?।]+[.!?।]*\\s*') else [v] end) as u from (select n, unnest(string_split({around('said')}, chr(10))) as v from placed)) where trim(u) != '' and len(regexp_extract_all(u, '[\\p{{L}}\\p{{M}}]')) >= 8)) where c >= 3)
 where {most} >= 2 and {most} > English"""


def verified_sql() -> str:
    """Findings of stage two: those of the sentence, that all that texts have of their own leaks, and that tasks are to be in English."""
    own = "select n as pair_id, case when confidence >= 0.7 then 'LEAKAGE' else 'UNSURE' end as category, label from own"
    return f"{_pairs_sql(LEFT_SAID)} {made.verified_sql('placed')} union all {own} union all select n, 'TASK', null from ({_foreign_sql()})"


def redaction_counts_sql() -> str:
    own = "select n as pair_id, 0::bigint as replaced, count(*) filter (confidence >= 0.7)::bigint as leaked, count(*) filter (confidence >= 0.7)::bigint as detections from own group by all"
    return f"{_pairs_sql(LEFT_SAID)} select pair_id, sum(replaced)::bigint as replaced, sum(leaked)::bigint as leaked, sum(detections)::bigint as detections from ({made.redaction_counts_sql('placed')} union all {own}) group by all"


PAIRS = "select conv_id * 100 + turn as n from conversations"
