"""Fixed values of the normalizer. They decide results, so they are listed as they are."""

# Words and patterns that the v3 normalizer knows.
NULL_WORDS = ["nan", "null", "<null>", "none", "n/a", "na"]
ZERO_WIDTH = "​‌‍﻿­"
SPLIT_CLASS = r"[\s,;:/\\()\[\]{}<>\"`~!@#$%^&*+=?|_\-\x{2013}\x{2014}\x{B7}\x{2022}\x{2026}\x{201C}\x{201D}\x{2018}\x{2019}'.\x{B0}\x{BA}\x{2116}]+"
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:co\.in|com|net|org|in|co|biz|info|fr|us|io)/?$"
ORDINAL = r"\b(\d+)(?:st|nd|rd|th|er|eme|e)\b"
HYPHEN_KEPT_APART = ["no", "nr", "ph", "st"]
# Letters that are words of their own in a country's addresses.
NOT_UNIT_LETTERS = {"us": "nsew", "france": "nsewrdl"}
NOT_UNIT_DEFAULT = "nsew"
LEET_FROM, LEET_TO = "013457", "oleast"

# Legal forms and their canonical forms.
LEGAL_FORMS = {
    "pvt": "private", "private": "private", "priv": "private", "pvtltd": "private",
    "ltd": "limited", "limited": "limited", "ltda": "limited", "limted": "limited",
    "inc": "inc", "incorporated": "inc", "incorp": "inc",
    "corp": "corp", "corporation": "corp",
    "co": "co", "company": "co", "cie": "co", "compagnie": "co",
    "llc": "llc", "llp": "llp", "lp": "lp", "pllc": "pllc", "plc": "plc", "pc": "pc", "pa": "pa", "opc": "opc",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci", "eurl": "eurl", "snc": "snc", "scop": "scop",
    "ei": "ei", "eirl": "eirl", "scp": "scp", "scs": "scs", "selarl": "selarl", "gie": "gie",
    "ets": "ets", "etablissements": "ets",
}
NAME_STOP = [
    "the", "of", "and", "for", "in", "at", "by", "a", "an", "to", "on", "dba", "aka", "du", "de", "des", "la", "le", "les", "et", "d", "l",
    "da", "del", "y",
]

# Address words, for all countries and by country; an empty word is dropped.
ADDRESS_WORDS = {
    "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "ln": "lane", "pkwy": "parkway",
    "hwy": "highway", "trl": "trail", "sq": "square", "apt": "apartment", "apts": "apartment", "appt": "apartment",
    "fl": "floor", "flr": "floor", "bldg": "building", "opp": "opposite", "nr": "near", "mkt": "market", "sec": "sector",
    "sect": "sector", "indl": "industrial", "soc": "society", "dist": "district", "distt": "district", "vill": "village",
    "no": "", "number": "", "pin": "", "pincode": "", "null": "", "nan": "", "none": "",
}
ADDRESS_WORDS_BY_COUNTRY = {
    "us": {
        "st": "street", "str": "street", "ste": "suite", "dr": "drive", "ct": "court", "pl": "place", "cir": "circle",
        "ter": "terrace", "terr": "terrace", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast",
        "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount", "ft": "fort", "pt": "point", "hts": "heights",
        "jct": "junction", "expy": "expressway", "fwy": "freeway", "cv": "cove", "xing": "crossing", "rte": "route",
        "ctr": "center", "cntr": "center", "unit": "", "suite": "suite",
    },
    "india": {
        "st": "street", "dr": "doctor", "hno": "house", "h": "house", "ind": "industrial", "est": "estate", "chs": "society",
        "bangalore": "bengaluru", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "gurgaon": "gurugram",
        "poona": "pune", "mysore": "mysuru", "trivandrum": "thiruvananthapuram", "baroda": "vadodara", "cochin": "kochi",
        "mangalore": "mangaluru", "belgaum": "belagavi", "pondicherry": "puducherry", "allahabad": "prayagraj",
        "benares": "varanasi", "simla": "shimla", "hubli": "hubballi", "orissa": "odisha", "tal": "taluka", "po": "post",
        "ps": "police", "vpo": "village",
    },
    "france": {
        "r": "rue", "st": "saint", "ste": "sainte", "bld": "boulevard", "boul": "boulevard", "pl": "place", "imp": "impasse",
        "ch": "chemin", "chem": "chemin", "rte": "route", "all": "allee", "fg": "faubourg", "fbg": "faubourg", "qu": "quai",
        "crs": "cours", "res": "residence", "bat": "batiment", "n": "", "d": "", "l": "", "de": "", "du": "", "des": "",
        "la": "", "le": "", "les": "", "cedex": "",
    },
}

# States and regions, and their codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in",
    "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
    "district of columbia": "dc", "puerto rico": "pr",
}
INDIA_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg",
    "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka",
    "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz",
    "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn",
    "tamilnadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk",
    "west bengal": "wb", "delhi": "dl", "nct of delhi": "dl", "jammu and kashmir": "jk", "jammu kashmir": "jk",
    "ladakh": "la", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "andaman and nicobar islands": "an",
    "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld",
}
INDIA_CODES = [
    "ap", "ar", "as", "br", "cg", "ct", "ga", "gj", "hr", "hp", "jh", "ka", "kl", "mp", "mh", "mn", "ml", "mz", "nl", "od", "or", "pb",
    "rj", "sk", "tn", "ts", "tg", "tr", "up", "uk", "ut", "wb", "dl", "jk", "ch", "py",
]
INDIA_CODE_ALIASES = {"or": "od", "ct": "cg", "tg": "ts", "ut": "uk"}
FRANCE_REGIONS = {
    "hauts de france": "hdf", "nouvelle aquitaine": "naq", "pays de la loire": "pdl", "ile de france": "idf", "grand est": "ges",
    "bretagne": "bre", "normandie": "nor", "occitanie": "occ", "provence alpes cote d azur": "pac",
    "auvergne rhone alpes": "ara", "bourgogne franche comte": "bfc", "centre val de loire": "cvl", "corse": "cor",
    "gironde": "naq", "loire atlantique": "pdl", "nord": "hdf", "pas de calais": "hdf",
}
STATES = {
    "us": US_STATES | {code: code for code in US_STATES.values()},
    "india": INDIA_STATES | {code: INDIA_CODE_ALIASES.get(code, code) for code in INDIA_CODES},
    "france": FRANCE_REGIONS,
}

# Spellings of one sound in consonant skeletons, in the order in which they are replaced; # stands for ch meanwhile.
SOUNDS_FIRST = [("chh", "ch"), ("ch", "#"), ("ck", "k")]
SOUNDS = [
    ("ph", "f"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("jh", "j"), ("c", "k"), ("q", "k"),
    ("x", "ks"), ("w", "v"), ("z", "s"),
]

# Offsets in an Indic block (all share one layout) and their Latin letters.
INDIC_VOWELS = {
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0C: "li", 0x0D: "e", 0x0E: "e", 0x0F: "e",
    0x10: "ai", 0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "ri", 0x61: "li",
}
INDIC_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x29: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x34: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x58: "q", 0x59: "kh", 0x5A: "g",
    0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
}
INDIC_FINALS = {0x4E: "t", 0x7A: "n", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "l", 0x7F: "k"}
INDIC_SIGNS = {
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x44: "ri", 0x45: "e", 0x46: "e", 0x47: "e", 0x48: "ai",
    0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x56: "ai", 0x57: "au", 0x62: "li", 0x63: "li",
}
INDIC_NUKTA = {"ph": "f", "j": "z", "k": "q", "d": "r", "dh": "rh"}
INDIC_NASALS, INDIC_VISARGA, INDIC_VIRAMA, INDIC_NUKTA_SIGN, INDIC_ZERO = (0x01, 0x02, 0x70), 0x03, 0x4D, 0x3C, 0x66

# The v1 normalizer's legal forms (without the dotted spellings, which its cleaning never leaves).
V1_LEGAL_FORMS = {
    "inc": "incorporated", "incorp": "incorporated", "incorporated": "incorporated", "corp": "corporation",
    "corporation": "corporation", "llc": "llc", "llp": "llp", "ltd": "limited", "limited": "limited", "co": "company",
    "company": "company", "lp": "lp", "pllc": "pllc", "pa": "pa", "pc": "pc", "na": "na", "pvt": "private",
    "private": "private", "priv": "private", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci",
    "eurl": "eurl", "snc": "snc", "scp": "scp", "groupe": "groupe", "cie": "company", "et": "and", "fils": "fils",
    "assoc": "associates", "associates": "associates", "intl": "international", "international": "international",
    "natl": "national", "national": "national", "grp": "group", "group": "group", "svcs": "services", "svc": "services",
    "services": "services", "mfg": "manufacturing", "manufacturing": "manufacturing", "enterprises": "enterprises",
    "enterprise": "enterprises", "foundation": "foundation", "fdn": "foundation", "holdings": "holdings",
    "holding": "holdings", "solutions": "solutions", "soln": "solutions", "technologies": "technologies",
    "tech": "technologies", "partners": "partners", "industries": "industries", "consultants": "consultants",
    "consulting": "consulting", "investments": "investments", "properties": "properties", "ventures": "ventures", "dba": "dba",
}
V1_NAME_STOP = [
    "the", "of", "and", "for", "in", "at", "by", "a", "an", "to", "on", "dba", "llc", "llp", "incorporated", "corporation", "limited",
    "private", "company", "sarl", "sas", "sasu", "sa", "sci", "eurl", "snc", "groupe", "fils", "et",
]
V1_INDIA_STATES = {
    "उत्तर प्रदेश": "uttar pradesh", "महाराष्ट्र": "maharashtra", "कर्नाटक": "karnataka", "ಕರ್ನಾಟಕ": "karnataka",
    "तमिल नाडु": "tamil nadu", "தமிழ் நாடு": "tamil nadu", "राजस्थान": "rajasthan", "गुजरात": "gujarat",
    "मध्य प्रदेश": "madhya pradesh", "बिहार": "bihar", "पश्चिम बंगाल": "west bengal", "तेलंगाना": "telangana",
    "आंध्र प्रदेश": "andhra pradesh", "केरल": "kerala", "छत्तीसगढ़": "chhattisgarh", "हरियाणा": "haryana",
    "दिल्ली": "delhi", "पंजाब": "punjab", "झारखण्ड": "jharkhand", "उत्तराखंड": "uttarakhand", "ओडिशा": "odisha",
    "असम": "assam", "गोवा": "goa", "हिमाचल प्रदेश": "himachal pradesh", "जम्मू और कश्मीर": "jammu and kashmir",
    "त्रिपुरा": "tripura", "मेघालय": "meghalaya", "मणिपुर": "manipur", "नागालैंड": "nagaland", "मिजोरम": "mizoram",
    "अरुणाचल प्रदेश": "arunachal pradesh", "सिक्किम": "sikkim", "चंडीगढ़": "chandigarh",
}

# Blocking keys, kind: (largest number of index records, weight). No number: the size of the index decides.
V1_KEYS = {
    "name": (1500, 1.0), "npair": (8000, 2.4), "addr": (1500, 0.9), "apair": (4000, 2.0), "num": (800, 1.2),
    "sig": (200, 2.8), "comp": (500, 2.2), "pref": (300, 0.8),
}
V3_KEYS = {
    "name": (1500, 1.0), "npair": (8000, 2.4), "phon": (1500, 0.7), "addr": (1500, 0.9), "apair": (4000, 2.0),
    "num": (800, 1.2), "sig": (200, 2.8), "comp": (500, 2.2), "unit": (300, 2.6), "pref": (300, 0.8),
    "ngname": (None, 1.5), "ngaddr": (None, 1.1), "nloc": (600, 1.6), "nnum": (600, 1.8), "ploc": (400, 2.2),
}
EXACT_WEIGHT, EXACT_SMALL, EXACT_LARGE = 40.0, 80, 400
