"""Texts made from a table by rule, with what is to be found in them: queries over the real operators whose SQL states
the result from the rule alone. An expression is SQL that Spark and DuckDB read alike; n is the row's number."""

from __future__ import annotations

from veilspark.functions.patterns import LABELS  # noqa: F401  (names of labels below are of this table)

_D = "lpad(cast(n % {m} as string), {k}, '0')"
N3, N4, N5, N6, N7 = (_D.format(m=10**k, k=k) for k in (3, 4, 5, 6, 7))
N, HEX = "cast(n as string)", "md5(cast(n as string))"
_PERSON = "(case n % 4 when 0 then 'Ravi Kumar' when 1 then 'Asha Shah' when 2 then 'Priya Sharma' else 'Arun Verma' end)"
_COMPANY = "(case n % 3 when 0 then 'Zentrix' when 1 then 'Bluepeak' else 'Orvanta' end)"

#: By detector: what stands before a value, the value (SQL), what stands after it, and the label it has to get (None: none).
DETECTED: dict[str, list[tuple[str, str, str, str | None]]] = {
    "name": [("Yesterday Mr. ", _PERSON, " called us.", "Person Name"), ("yesterday it was ", f"'item ' || {N}", " again", None)],
    "email": [
        ("Write to ", f"'user' || {N} || '@gmail.com'", " now", "Person Email"), ("Write to ", f"'user' || {N} || '@acmeworks.in'", " now", "Business Email"),
        ("Write to ", f"'sales' || '@firm' || {N} || '.com'", " now", "Business Email"), ("Write to ", f"'user' || {N} || '@mail.example.com'", " now", None),
    ],
    "phone": [
        ("Call my mobile ", f"'98765' || {N5}", " today", "Person Phone No"), ("Toll free ", f"'1800 123 ' || {N4}", " today", "Business Phone No"),
        ("The office line is ", f"'+44 20 7946 ' || {N4}", " today", "Business Phone No"), ("Order ", f"'12345' || {N5}", " came", None),
    ],
    "date": [("Date of birth: ", "'0' || cast(1 + n % 9 as string) || '/0' || cast(1 + n % 7 as string) || '/19' || cast(70 + n % 30 as string)", "", "Person DOB"), ("Invoice date: ", "'0' || cast(1 + n % 9 as string) || '/0' || cast(1 + n % 7 as string) || '/2021'", "", None)],
    "username": [("Ping ", f"'@ravi' || {N}", " please", "Person Username"), ("username: ", f"'ravi' || {N}", " set", "Person Username"), ("Follow the company ", f"'@ravi' || {N}", " please", "Business Username"), ("Room ", f"'ravi' || {N}", " is free", None)],
    "address": [("Address: ", "'Flat ' || cast(1 + n % 90 as string) || ', 4th Cross Road, Indiranagar, Bengaluru 560038'", "", "Person Address"), ("They met on ", f"'level ' || {N}", " again", None)],
    "business": [("He works at ", f"{_COMPANY} || ' Technologies Pvt Ltd'", " now", "Business Name"), ("he works at ", f"'desk ' || {N}", " now", None)],
    "account": [("Account number: ", f"'1234' || {N7}", " closed", "Account Number"), ("savings ", f"'XXXX' || {N4}", " closed", "Account Number"), ("the bank said ", f"'123456' || {N7}", " closed", "Account Number"), ("order ", f"'123456' || {N7}", " closed", None)],
    "ifsc": [("IFSC ", f"'HDFC0' || {N6}", " here", "IFSC Code"), ("code ", f"'HDFC1' || {N6}", " here", None)],
    "pan": [("PAN ", f"'ABCPK' || {N4} || 'L'", " here", "PAN Card Number"), ("part ", f"'ABCP' || {N4} || 'L'", " here", None)],
    "address-ip": [
        ("host ", "'10.1.' || cast(n % 256 as string) || '.' || cast(n % 199 as string)", " up", "IP/MAC Address"), ("card ", "'00:1a:2b:3c:4d:' || lpad(cast(n % 100 as string), 2, '0')", " up", "IP/MAC Address"),
        ("host ", "'2001:db8::' || cast(n % 9999 as string)", " up", "IP/MAC Address"), ("version ", "'1.2.' || cast(n % 256 as string)", " up", None),
    ],
    "key": [
        ("api_key=", f"'Ab' || {HEX}", " set", "API/Private Keys"), ("Authorization: Bearer ", HEX, " sent", "API/Private Keys"), ("aws ", "'AKIA' || lpad(cast(n as string), 16, '0')", " set", "API/Private Keys"), ("aws ", "'AKIA' || lpad(cast(n as string), 10, '0')", " set", None),
    ],
    "password": [("password: ", f"'Zq9!' || {N}", " set", "Password"), ("Your OTP is ", N6, " today", "Password"), ("sword: ", f"'Zq9!' || {N}", " set", None)],
    "aadhaar": [("Aadhaar ", f"'2345 6789 ' || {N4}", " seen", "Aadhar Card No"), ("aadhaar ", f"'XXXX XXXX ' || {N4}", " seen", "Aadhar Card No"), ("account ", f"'2345 6789 ' || {N4}", " seen", None)],
    "license": [("permit ", f"'KA01 2011 ' || {N7}", " seen", "Driving License No"), ("permit ", f"'ZZ01 2011 ' || {N7}", " seen", None)],
    "voter": [("Voter ", f"'ABC' || {N7}", " seen", "Voter ID"), ("code ", f"'ABCD' || {N7}", " seen", None)],
    "card": [
        ("Visa card ", f"'4111 1111 1111 ' || {N4}", " used", "Credit/Debit Card No"), ("cvv ", N3, " used", "Credit/Debit Card No"), ("paid by ", f"'XXXX XXXX XXXX ' || {N4}", " then", "Credit/Debit Card No"),
        ("valid thru ", "'0' || cast(1 + n % 9 as string) || '/2' || cast(n % 10 as string)", " only", "Credit/Debit Card No"), ("savings account ", f"'1234567890' || {N4}", " used", None),
    ],
    "upi": [("pay ", f"'ravi' || {N} || '@okaxis'", " now", "UPI ID"), ("pay ", f"'ravi' || {N} || '@randombank'", " now", None)],
    "transaction": [("Txn ID: ", f"'TX' || lpad({N}, 10, '0')", " done", "Transaction ID"), ("hash ", f"'0x' || {HEX} || {HEX}", " done", "Transaction ID"), ("hash ", f"'0x' || {HEX}", " done", None)],
    "invocation": [("Invocation ID: ", f"'a1' || {HEX}", " ran", "Invocation ID"), ("Session ", f"'a1' || {HEX}", " ran", None)],
    "hash": [("digest ", HEX, " kept", "SHA/SSH/Hash Key"), ("digest ", f"'sha256:' || {HEX} || {HEX}", " kept", "SHA/SSH/Hash Key"), ("digest ", f"substring({HEX}, 1, 31)", " kept", None)],
    "vpc": [("in ", f"'vpc-' || substring({HEX}, 1, 8)", " up", "VPC ID"), ("in ", f"'vpc-' || substring({HEX}, 1, 9)", " up", None)],
    "card-id": [("token ", f"'tok_' || {HEX}", " kept", "Card ID"), ("token ", f"'tok_' || {N3}", " kept", None)],
    "account-id": [("AWS account ", f"'123456' || {N6}", " owns it", "Account ID"), ("arn:aws:s3:eu:", f"'123456' || {N6}", ":bucket", "Account ID"), ("order ", f"'123456' || {N6}", " came", None)],
}

ROWS = "select c_custkey as n from customer"


def cases(values: list[str]) -> str:
    return "case n % " + str(len(values)) + " " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def text_of(detector: str) -> str:
    return cases([f"{quoted(a)} || {v} || {quoted(z)}" for a, v, z, _ in DETECTED[detector]])


def expected(detector: str) -> str:
    """The detections that are to come out, as SQL."""
    d = DETECTED[detector]
    parts = [f"select n as doc, {len(a)} as start, {len(a)} + length({v})::int as \"end\", {quoted(label)} as label, {v} as text from ({ROWS}) where n % {len(d)} = {k}" for k, (a, v, _, label) in enumerate(d) if label]
    return " union all ".join(parts)

#: Pairs whose right side is the left one with a label on a part of it: before, value, after; the label, from where to
#: where (SQL, from the value's start on; None: on all of it) and whether its name is known; and the finding.
_MAIL = f"'user' || {N} || '@gmail.com'"
COMPARED: list[tuple[str, str, str, tuple[str, str | None, str | None, bool] | None, tuple[str, str, str | None]]] = [
    ("Write to ", _MAIL, " now please", ("Person Email", None, None, True), ("CORRECT", "Person Email", "Person Email")),
    ("Write to ", _MAIL, " now please", ("UPI ID", None, None, True), ("WRONG_LABEL", "Person Email", "UPI ID")),
    ("Write to ", _MAIL, " now please", None, ("MISSED", "Person Email", None)),
    ("The word ", f"'thing' || {N}", " stands here", ("Person Name", None, None, True), ("OVERSCRUB", "Person Name", "Person Name")),
    ("The word ", f"'thing' || {N}", " stands here", ("Whatever", None, None, False), ("NEEDS_REVIEW", "Whatever", "Whatever")),
    ("The word ", f"'thing' || {N}", " stands here", ("Overscrubbed", None, None, True), ("CORRECT", "Overscrubbed", "Overscrubbed")),
    ("Write to ", _MAIL, " now please", ("Overscrubbed", None, None, True), ("NEEDS_REVIEW", "Person Email", "Overscrubbed")),
    ("Write to ", _MAIL, " now please", ("Person Email", "-9", "+ 11", True), ("NEEDS_REVIEW", "Person Email", "Person Email")),
    ("the bank said ", f"'123456' || {N7}", " closed", ("Person Phone No", None, None, True), ("NEEDS_REVIEW", "Account Number", "Person Phone No")),
    ("the bank said ", f"'123456' || {N7}", " closed", None, ("NEEDS_REVIEW", "Account Number", None)),
]
#: What stage one asks for, by a case of COMPARED: category, group, status, suggest.
ASKED = [
    ("IDENTIFIED", "PI", "labeled", "yes"), ("PI_TODO", "PI", "wrong", "yes"), ("PI_TODO", "PI", "unlabeled", "yes"), ("NOT_PII", None, "extra", "not"), ("CHECK", None, "check", "unsure"),
    ("NOT_PII", None, "extra", "not"), ("PI_TODO", "PI", "check", "unsure"), ("PI_TODO", "PI", "check", "unsure"), ("CRED_TODO", "CRED", "check", "unsure"), ("CRED_TODO", "CRED", "unlabeled", "unsure"),
]


def compared_text() -> str:
    return cases([f"{quoted(a)} || {v} || {quoted(z)}" for a, v, z, _, _ in COMPARED])


def compared_label() -> tuple[str, str, str, str]:
    """Name (null: no label), known, start and end, as SQL."""
    one = lambda f: cases([f(c) for c in COMPARED])
    start = lambda c: f"{len(c[0])} {c[3][1] or ''}" if c[3] else "0"
    end = lambda c: f"{len(c[0])} + cast(length({c[1]}) as int) {c[3][2] or ''}" if c[3] else "0"
    return one(lambda c: quoted(c[3][0]) if c[3] else "cast(null as string)"), one(lambda c: str(bool(c[3] and c[3][3])).lower()), one(start), one(end)


def compared_sql(rows: str, at: str) -> str:
    """The findings that are to come out of rows. One whose label stands alone has the label's place, others the detection's. at: what stands before the sentence."""
    parts = []
    for k, (a, v, _, label, (category, name, right)) in enumerate(COMPARED):
        own = category == "OVERSCRUB" or name in ("Whatever", "Overscrubbed") or (category, right) == ("NEEDS_REVIEW", "Overscrubbed")
        end = f"{len(a)} + length({v})"
        first, last = (f"{len(a)} {label[1] or ''}", f"{end} {label[2] or ''}") if label else (str(len(a)), end)
        left = (first, last) if own else (str(len(a)), end)
        parts.append(
            f"select n as pair_id, {quoted(category)} as category, {quoted(name)} as label, {quoted(right) if right else 'null::varchar'} as right_label, ({at}{left[0]})::int as left_start, ({at}{left[1]})::int as left_end, "
            f"({at}{first})::int as right_start, ({at}{last})::int as right_end from {rows} where n % {len(COMPARED)} = {k}"
        )
    return " union all ".join(parts)


def asked_sql(rows: str) -> str:
    word = lambda x: quoted(x) if x else "null::varchar"
    return " union all ".join(f"select n as pair_id, {', '.join(f'{word(x)} as {c}' for x, c in zip(a, ('category', chr(34) + 'group' + chr(34), 'status', 'suggest')))} from {rows} where n % {len(COMPARED)} = {k}" for k, a in enumerate(ASKED))


#: Pairs of texts, and the findings of stage two: (category, label) each.
_NAME = _PERSON
VERIFIED: list[tuple[str, str, list[tuple[str, str | None]]]] = [
    (f"'Mr. ' || {_NAME} || ' called'", f"'Mr. ' || {_NAME} || ' called'", [("LEAKAGE", "Person Name")]),
    (f"'Mr. ' || {_NAME} || ' called'", "'Mr. Vikram Nair called'", [("REDACTED_OK", "Person Name")]),
    (f"'Mr. ' || {_NAME} || ' called'", "'Mr. [NAME] called'", [("NOT_SENSIBLE", "Person Name")]),
    (f"'Mr. ' || {_NAME} || ' called'", "'Mr. XXXXX called'", [("NOT_SENSIBLE", "Person Name")]),
    (f"'Mr. ' || {_NAME} || ' called'", "'Mr. 12345678 called'", [("DATATYPE", "Person Name")]),
    (f"'Mr. ' || {_NAME} || ' called'", "'Mr. Vikram Nair called twice'", [("REDACTED_OK", "Person Name"), ("UNKNOWN_TEXT", None)]),
    (f"'The thing' || {N} || ' is green now'", f"'The thing' || {N} || ' is purple now'", [("OVER_REDACTED", None)]),
    (f"'The thing' || {N} || ' is green now'", f"'The thing' || {N} || ' is green now'", []),
    (f"'Write to ' || {_MAIL} || ' now'", "'Write to other@gmail.com now'", [("REDACTED_OK", "Person Email")]),
    (f"'Call my mobile 98765' || {N5} || ' today'", f"'Call my mobile 98765' || {N5} || ' today'", [("LEAKAGE", "Person Phone No")]),
    (f"'the bank said 123456' || {N7} || ' closed'", f"'the bank said 123456' || {N7} || ' closed'", [("UNSURE", "Account Number")]),
    (f"'Mr. ' || {_NAME} || ' met. Then Mr. ' || {_NAME} || ' left'", "'Mr. Vikram Nair met. Then Mr. Mohan Iyer left'", [("REDACTED_OK", "Person Name"), ("INCOHERENT", "Person Name")]),
    ("'Mr. Ravi Kumar met. Then Ms. Asha Shah left'", "'Mr. Vikram Nair met. Then Ms. Vikram Nair left'", [("REDACTED_OK", "Person Name"), ("INCOHERENT", "Person Name")]),
]


def verified_sql(rows: str) -> str:
    return " union all ".join(
        f"select n as pair_id, {quoted(c)} as category, {quoted(label) if label else 'null::varchar'} as label from {rows} where n % {len(VERIFIED)} = {k}" for k, (_, _, found) in enumerate(VERIFIED) for c, label in found
    )


def label_counts_sql(labels: list[str], rows: str) -> str:
    """By pair and label what is detected and what is given; only labels that occur have rows."""
    parts = []
    for k, (_, _, _, label, (category, name, _)) in enumerate(COMPARED):
        detected = None if category == "OVERSCRUB" or name in ("Whatever", "Overscrubbed") else name
        given = label[0] if label else None
        for own in sorted({x for x in (detected, given) if x in labels}):
            parts.append(f"select n as pair_id, {quoted(own)} as label, {int(own == detected)}::bigint as detected, {int(own == given)}::bigint as labeled from {rows} where n % {len(COMPARED)} = {k}")
    return " union all ".join(parts)


#: Replaced, leaked and detected values of each case of VERIFIED.
REDACTED = [(0, 1, 1), (1, 0, 1), (1, 0, 1), (1, 0, 1), (1, 0, 1), (1, 0, 1), (0, 0, 0), (0, 0, 0), (1, 0, 1), (0, 1, 1), (0, 0, 0), (2, 0, 2), (2, 0, 2)]


def redaction_counts_sql(rows: str) -> str:
    return " union all ".join(f"select n as pair_id, {a}::bigint as replaced, {b}::bigint as leaked, {c}::bigint as detections from {rows} where n % {len(VERIFIED)} = {k}" for k, (a, b, c) in enumerate(REDACTED))


# lines that no other line is like -----------------------------------------------------------------------------------


def line(k: str) -> str:
    """The k-th line of row n: four words of eight letters."""
    h = f"md5(cast(n as string) || '-' || cast({k} as string))"
    return " || ' ' || ".join(f"substring({h}, {1 + 8 * i}, 8)" for i in range(4))


def lines(first: int, last: int) -> str:
    """Lines first..last, parted by line breaks."""
    return " || chr(10) || ".join(f"({line(str(k))})" for k in range(first, last + 1))


#: Texts of one language each and what the report says: verdict, main language.
SPOKEN = [
    ("'The river is wide and the road to the old town is closed for the winter number ' || cast(n as string)", "english", None),
    ("'El camino de la casa es largo y los niños de la escuela están en el parque con las madres ' || cast(n as string)", "other", "Spanish"),
    ("'Der Weg zu dem Haus ist lang und die Kinder sind nicht mit den Eltern in der Stadt ' || cast(n as string)", "other", "German"),
    ("'Le chemin de la maison est long et les enfants de la ville sont dans une école pour les petits ' || cast(n as string)", "other", "French"),
    ("'The river is wide and the road to the old town is closed for the winter and the bridge is closed as well' || chr(10) || 'El camino de la casa es largo y los niños están en el parque ' || cast(n as string)", "mixed", "Spanish"),
]

#: Names of labels as sites write them, and what they stand for.
WRITTEN = [("person-email", "Person Email"), ("EMAIL Address", "Person Email"), ("company", "Business Name"), ("ifsc_code", "IFSC Code"), ("aws account", "Account ID"), ("Overscrub", "Overscrubbed"), ("colour", None)]
