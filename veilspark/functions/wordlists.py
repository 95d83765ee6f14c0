"""Word lists and patterns of the heuristic rules.

FIXED VALUES: everything in this module is given and has to stay as it is for results to agree.
"""

from __future__ import annotations

import re

# names of people
NAME_WORD = r"(?:[A-Z][a-z]+(?:[A-Z][a-z]+)?(?:['’-][A-Za-z]+)?|[A-Z]{2,}(?![A-Za-z])|[A-Z]\.)"
NAME_STOP = (
    "address addr phone mobile mob tel ph email e-mail date dob road rd street st nagar layout bank ltd pvt private limited inc llc llp corp "
    "the and of for from to at in on by with account customer number no dear sir madam team manager policy name city state india "
    "regards thanks thank sincerely mr mrs ms dr hi hello contact id pan aadhaar office company department ref subject re please kindly "
    "yours signature signed fax gst gstin invoice amount total branch ifsc website url username password pin otp apartment apartments flat "
    "floor cross main sector block colony lane tower phase stage user login card vehicle registration reg world all everyone there valued "
    "friends folks members staff support sales admin hr employee employer client applicant nominee holder father mother spouse guardian "
    "desk loan care helpdesk management operations accounts billing service services department branch bank head "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december"
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Shri", "Smt", "Sri", "Kum", "Kumari", "Capt", "Col", "Adv", "Er")
NAME_FIELDS = (
    "Name", "Full Name", "Customer Name", "Client Name", "Applicant Name", "Applicant", "Account Holder Name", "Account Holder",
    "Account Name", "Nominee Name", "Nominee", "Father's Name", "Father Name", "Mother's Name", "Mother Name", "Spouse Name",
    "Guardian Name", "Guardian", "Employee Name", "Patient Name", "Student Name", "Candidate Name", "Beneficiary Name",
    "Beneficiary", "Holder Name", "Contact Person", "Signed by", "Prepared by", "Approved by", "Reviewed by",
    "Authorised Signatory", "Authorized Signatory", "First Name", "Last Name", "Surname",
)
SALUTATIONS = ("Dear", "Hi", "Hello", "Hey", "Attn", "Attention")
SIGNOFFS = ("Regards", "Best regards", "Kind regards", "Warm regards", "Sincerely", "Thanks", "Thank you", "Best", "Cheers", "Yours truly", "Yours sincerely", "Yours faithfully")
RELATIONS = ("S/O", "D/O", "W/O", "C/O", "son of", "daughter of", "wife of", "husband of")
INTRODUCTIONS = ("my name is", "mera naam", "mera name", "myself", "this is")
NOT_A_PERSON = r"(?:company|business|firm|bank|organi[sz]ation|product|file|domain|user|place|brand|shop|store|project|branch|event|plan|scheme|course|app|device|host|server|vendor|merchant)[ \t]*\Z"
HEADING_WORDS = (
    "resume curriculum vitae cv profile summary objective skills experience education contact details information personal report invoice statement "
    "letter agreement form application certificate receipt notice minutes meeting notes policy offer document page annual monthly quarterly project "
    "proposal plan schedule key"
)
FIRST_LINE = r"^\s*([A-Z][a-z]+(?:[ \t]+(?:[A-Z]\.|[A-Z][a-z]+)){1,3})[ \t]*(?:\r?\n|\Z)"

# dates
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(?![a-z])"
BIRTH_WORD = r"\b(?:d\.?\s?o\.?\s?b\.?|date\s+of\s+birth|birth\s*-?\s*date|birth\s*day|b['’]?\s?day|born(?:\s+on)?)(?![a-z])"
DATES = (
    ("dob-dmy", r"(?<![\w\/.:-])(\d{1,2})([\/.-])(\d{1,2})\2(\d{4}|\d{2})(?![\w\/:-]|\.\d)", re.A),
    ("dob-ymd", r"(?<![\w\/.:-])(\d{4})([\/.-])(\d{1,2})\2(\d{1,2})(?![\w\/:-]|\.\d)", re.A),
    ("dob-d-month-y", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?(?:[ \t]+of)?[ \t-]+{MONTH}\.?,?[ \t-]+(?:\d{{4}}|'\d{{2}})\b", re.A | re.I),
    ("dob-month-d-y", rf"\b{MONTH}\.?[ \t]+(\d{{1,2}})(?:st|nd|rd|th)?,?[ \t]+\d{{4}}\b", re.A | re.I),
    ("dob-month-y", rf"\b{MONTH}\.?,?[ \t]+(?:19|20)\d{{2}}\b", re.A),
    ("dob-d-month", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?[ \t]+{MONTH}\b", re.A),
)
FORMAT_HINT = r"\(?\s*[dmy]{1,4}(?:\s*[\/.-]\s*[dmy]{1,4}){2}\s*\)?"
GAP_BEFORE = r"^[\s:=|(\[\]–-]*(?:(?:is|was|on|as|per|records?|:)[\s:=|(\[\]–-]*){0,3}\Z"
GAP_AFTER = r"^[ \t]*[(\[–-]?[ \t]*\Z"

# companies
COMPANY_WORD = r"(?:[A-Z][A-Za-z0-9&'’.\-]*|&)"
COMPANY_JOIN = r"(?:[ \t]+(?:and|of|&|the|for))?[ \t]+"
LEGAL = r"(?:Pvt\.?[ \t]*Ltd|Private[ \t]+Limited|Pte\.?[ \t]+Ltd|Ltd|Limited|Inc|Incorporated|LLC|L\.L\.C|LLP|Corp|Corporation|PLC|GmbH|Co)"
GENERIC = (
    r"(?:Technologies|Technology|Tech|Solutions|Industries|Enterprises|Group|Services|Systems|Consultants|Consulting|Labs|"
    r"Software|Infotech|Infosystems|Associates|Traders|Trading|Exports|Imports|Foundation|Trust|Hospitals?|Clinic|Bank|Insurance|Motors|"
    r"Pharma|Pharmaceuticals|Logistics|Holdings|Ventures|Capital|Finance|Agency|Studios?|Media|Networks|Electronics|Textiles|"
    r"Constructions?|Builders|Developers|Realty|Foods|Retail|Mart|Stores|Company)"
)
COMPANY_FIELDS = (
    "Company", "Company Name", "Employer", "Organisation", "Organization", "Firm", "Business", "Business Name",
    "Merchant", "Vendor", "Supplier", "Client Company", "Insurer", "Bank", "Bank Name",
)
BANK_OF = r"\b(?:(?:State|Central|Union|Reserve|Punjab[ \t]+National)[ \t]+)?Bank[ \t]+of[ \t]+[A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)?"
FIELDS_OF_WORK = (
    "information computer computing financial medical health healthcare food data digital software business mechanical electrical electronic civil "
    "chemical biomedical industrial engineering education legal banking customer it cloud web mobile network security"
)
PRODUCTS = r"^(?:Visual|Android|Xcode|SQL|Power|Google|Microsoft|Adobe|Unity|Creative|Data|Cloud|Developer|Expo|R)\s+(?:Studio|Server|Labs?|Services|Systems|Technologies|Tech|Media)\Z"
COMPANY_LEAD = (
    "the a an at in on for from with by to and of our your this that these those dear mr mrs ms dr hi hello employer company client vendor via per as is "
    "was we i he she they it my his her their contact call visit please"
)

# the dictionary of names that are public
LEGAL_END = r"(?:Pvt\.?\s*Ltd|Private\s+Limited|Ltd|Limited|Inc|Incorporated|LLP|LLC|Corp|Corporation|PLC|Co|Group|Technologies)\.?"
OPENERS = (
    "visit visited join joined contact call email ask at from with by to in for our your their the a an and or but try use used buy shop order employer "
    "company client vendor bank work works worked thanks thank via see"
)

# addresses
ADDRESS_STRONG = (
    "road rd street st nagar layout marg lane ln colony apartment apartments apts apt society chowk avenue ave village vill district dist taluk taluka "
    "tehsil mandal enclave residency vihar puram gali mohalla bazaar bazar highway hwy expressway boulevard blvd towers nivas niwas bhavan bhawan "
    "heights halli palya peth wadi"
)
ADDRESS_WEAK = "main cross sector block phase stage floor tower circle extension extn wing plot flat house door unit suite ward pocket building bldg"
ADDRESS_LOWER = "near opp opp. opposite behind beside off next"
ADDRESS_STOP = (
    "phone ph tel mob mobile email e-mail fax website web gst gstin pan aadhaar dob date name dear mr mrs ms smt shri sri dr i he she we they you our my "
    "his her their the this that please contact call visit regards thanks office home residence address addr located situated residing lives live at in "
    "is was and or but from to for with on of by as account card customer policy email username password otp ip vehicle subject note"
)
ADDRESS_ABBREVIATIONS = "no rd st opp nr apt apts bldg ave dist vill extn h flat ln blvd hwy"
CITIES = (
    "Bengaluru|Bangalore|Mumbai|Bombay|Delhi|New Delhi|Chennai|Madras|Kolkata|Calcutta|Hyderabad|Secunderabad|Pune|Ahmedabad|Jaipur|Lucknow|Kochi|Cochin|"
    "Mysuru|Mysore|Noida|Gurugram|Gurgaon|Ghaziabad|Faridabad|Chandigarh|Indore|Bhopal|Coimbatore|Visakhapatnam|Vizag|Nagpur|Surat|Vadodara|Patna|"
    "Thiruvananthapuram|Trivandrum|Mangaluru|Mangalore|Hubli|Belagavi|Madurai|Vijayawada|Bhubaneswar|Guwahati|Dehradun|Ranchi|Raipur|Nashik|Thane|"
    "Navi Mumbai|Goa|Panaji"
)
STATES = (
    "Karnataka|Maharashtra|Tamil Nadu|Kerala|Telangana|Andhra Pradesh|Gujarat|Rajasthan|Uttar Pradesh|West Bengal|Punjab|Haryana|Bihar|Odisha|Orissa|"
    "Madhya Pradesh|Assam|Jharkhand|Chhattisgarh|Uttarakhand|Himachal Pradesh|Jammu and Kashmir|Tripura|Meghalaya|Manipur|Nagaland|Sikkim"
)
BUSINESS_BEFORE = r"\b(?:office|branch|registered|regd|head[ -]?office|hq|headquarters|corporate|factory|plant|warehouse|godown|showroom|store|outlet|campus|works|company|business|vendor|supplier|client|our)\b"
BUSINESS_IN = r"\b(?:plot|sector|industrial|indl|tech[ -]?park|it[ -]?park|sez|business[ -]?park|estate|tower|floor|unit[ -]?no|shop[ -]?no|complex|pvt|ltd|limited|midc|kiadb)\b"
HOME_BEFORE = r"\b(?:home|residence|residential|resides|residing|lives|living|permanent|correspondence|mailing|my|his|her|their|customer|applicant|deliver(?:ed|y)? to|ship to)\b"
HOME_IN = r"\b(?:flat|house|h\.?\s?no|apartment|apartments|apts|villa|bungalow|colony|society|nagar|layout)\b"
PIN_CODE = r"(?<!\d)[1-9]\d{2}[ ]?\d{3}(?!\d)"
ORDINAL = r"\b\d{1,3}(?:st|nd|rd|th)\b"
HOUSE = r"(?:#[ ]?\d+|\b(?:no|flat|h|house|door|plot|unit|shop|apt)\.?[ ]*(?:no\.?)?[ ]*[:#.]?[ ]*\d+[A-Z]?\b|\b\d{1,5}[A-Z]?[ ]*[\/-][ ]*\d{1,5}[A-Z]?\b|^\d{1,5}[A-Z]?\b)"
PIN_WORD = r"\b(?:pin|pincode|pin code|zip|postal|post)\b"
ADDRESS_KEY = r"\b\d+(?:st|nd|rd|th)?[ ]+(?:main|cross|sector|block|phase|stage|floor)\b|\b(?:sector|block|phase|stage|floor|tower|wing|plot|flat)[ ]+(?:\d+|[A-Z])\b"
ADDRESS_NUMBER = r"^#?\d{1,6}[A-Za-z]?(?:[\/-]\d{1,6}[A-Za-z]?)*\Z|^\d{1,3}(?:[sS][tT]|[nN][dD]|[rR][dD]|[tT][hH])\Z"
MOST_LEFT, MOST_TOKENS = 12, 32
