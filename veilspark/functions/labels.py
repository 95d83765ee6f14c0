"""Names of labels as sites write them.

FIXED VALUES: the aliases and the pattern of placeholders are given."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.patterns import LABELS

PLACEHOLDER = r"\[([A-Z][A-Z0-9 _/]*[A-Z0-9])\]"
ALIASES = {
    "Person Name": "personname name person fullname alias",
    "Person Email": "personemail email emailaddress personalemail",
    "Person Phone No": "personphoneno personphone phone phoneno phonenumber mobile contactnumber contact",
    "Person DOB": "persondob dob dateofbirth date",
    "Person Username": "personusername username handle",
    "Person Address": "personaddress address homeaddress addr",
    "Business Name": "businessname business company organization organisation org",
    "Business Email": "businessemail companyemail officialemail",
    "Business Phone No": "businessphoneno businessphone officephone",
    "Business Username": "businessusername companyusername",
    "Business Address": "businessaddress officeaddress companyaddress",
    "Account Number": "accountnumber accountno bankaccount account",
    "IFSC Code": "ifsccode ifsc",
    "PAN Card Number": "pancardnumber pancard pan panno",
    "IP/MAC Address": "ipmacaddress ipaddress ip macaddress mac",
    "API/Private Keys": "apiprivatekeys apikey apikeys privatekey token",
    "Password": "password credentials credential pin otp",
    "Aadhar Card No": "aadharcardno aadhaar aadhar aadhaarnumber",
    "Driving License No": "drivinglicenseno drivinglicence drivinglicense dl",
    "Voter ID": "voterid epic",
    "Credit/Debit Card No": "creditdebitcardno cardnumber creditcard debitcard",
    "UPI ID": "upiid upi vpa",
    "Transaction ID": "transactionid txnid utr",
    "Invocation ID": "invocationid requestid",
    "SHA/SSH/Hash Key": "shasshhashkey hash sshkey hashkey",
    "VPC ID": "vpcid vpc",
    "Card ID": "cardid cardtoken",
    "Account ID": "accountid awsaccount awsaccountid",
    "Overscrubbed": "overscrubbed overscrub",
}


def plain(name: str | None) -> str:
    return re.sub("[^a-z0-9]", "", (name or "").lower())


_BY_NAME = {plain(n): n for n, _ in LABELS} | {a: n for n, aliases in ALIASES.items() for a in aliases.split()}


def resolve(name: str | None, more: dict[str, str] | None = None) -> str | None:
    return (more or {}).get(plain(name)) or _BY_NAME.get(plain(name))


def resolve_column(name: Column) -> Column:
    by = F.create_map(*(F.lit(x) for kv in _BY_NAME.items() for x in kv))
    return F.try_element_at(by, F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", ""))


def is_placeholder(text: str, pattern: str = PLACEHOLDER) -> bool:
    t = text.strip()
    return not t or bool(pattern and re.fullmatch(pattern, t)) or re.fullmatch(r"[\[<{(].*[\]>})]", t) is not None and resolve(t[1:-1]) is not None
