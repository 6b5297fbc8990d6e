"""Vocabularies, patterns and constants that results depend on."""

from __future__ import annotations

# Scripts of U+0900 to U+0D7F, and the sounds of letters by their Unicode names.
SCRIPTS = ["DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM"]
VOWELS = {
    "A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "VOCALIC R": "ri", "VOCALIC RR": "ri", "VOCALIC L": "li",
    "E": "e", "EE": "e", "SHORT E": "e", "AI": "ai", "O": "o", "OO": "o", "SHORT O": "o", "AU": "au", "CANDRA E": "e",
    "CANDRA O": "o",
}
CONSONANTS = {
    "nn": "n", "tt": "t", "dd": "d", "ss": "sh", "ll": "l", "rr": "r", "ny": "n", "nng": "n", "ng": "n", "lll": "l",
    "ddh": "dh", "tth": "th",
}
NATIVE = "[ऀ-ൿ]"

# Letters that digits stand for; skeleton replacements, in order; pattern of aliases and web names.
LEET_FROM, LEET_TO = "0135", "oles"
SKELETON = [("ph", "f"), ("w", "v"), ("q", "k"), ("x", "ks"), ("c", "k"), ("z", "j"), ("g", "j"), ("h", "")]
ALIAS = (
    r"\b(?:d\s*/\s*b\s*/\s*a|dba|doing business as|formerly known as|formerly|f\s*/\s*k\s*/\s*a|fka|"
    r"a\s*/\s*k\s*/\s*a|aka|also known as|trading as|t\s*/\s*a)\b"
)
WEB = r"(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co|fr|biz|info|us|io)\b"

# Legal forms, fillers, and skeletons of legal forms.
LEGAL = [
    "inc", "incorporated", "llc", "l", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "lp",
    "llp", "pc", "plc", "pllc", "lc", "the", "sarl", "sas", "sa", "eurl", "sci", "ei", "sasu", "snc", "scop", "gie",
    "selarl", "and", "of", "de", "du", "des", "la", "le", "les", "et", "pty", "gmbh", "ag", "opc",
]
FILLER = [
    "services", "service", "center", "centre", "group", "groupe", "partners", "holdings", "holding", "solutions",
    "enterprises", "enterprise", "international", "global", "compagnie", "cie", "etablissements", "ets", "shri", "sri",
    "shree", "m", "s", "ms",
]
LEGAL_SKELETONS = ["prvt", "lmtd", "lmtt", "prvtd"]

# Canonical address words with their variants, and words that are dropped.
ADDRESS_WORDS = {
    "st": ["street", "st", "str", "saint", "sainte", "stree", "streeet"], "rd": ["road", "rd"], "av": ["avenue", "ave", "av", "aven", "avn"],
    "dr": ["drive", "dr", "drv"], "ln": ["lane", "ln"], "ct": ["court", "ct", "crt"],
    "cir": ["circle", "cir", "circ"], "bd": ["boulevard", "blvd", "bd", "boul", "bvd"], "pl": ["place", "pl"],
    "pkwy": ["parkway", "pkwy", "pky"], "hwy": ["highway", "hwy"], "ter": ["terrace", "ter", "terr"],
    "trl": ["trail", "trl"], "sq": ["square", "sq"], "n": ["north", "n", "nord"],
    "s": ["south", "s", "sud"], "e": ["east", "e", "est"], "w": ["west", "w", "ouest"],
    "rue": ["rue", "r"], "ch": ["chemin", "ch", "chem"], "imp": ["impasse", "imp"],
    "all": ["allee", "all"], "rte": ["route", "rte"], "qu": ["quai", "qu"],
    "mt": ["mount", "mt", "mont"], "ft": ["fort", "ft"], "pt": ["point", "pt"],
    "ctr": ["center", "ctr", "centre", "cntr"], "hts": ["heights", "hts"], "ext": ["extension", "extn", "ext"],
    "bldg": ["building", "bldg", "bldng"], "opp": ["opposite", "opp"], "sec": ["sector", "sec", "sect"],
    "col": ["colony", "col"], "ngr": ["nagar", "ngr"], "mkt": ["market", "mkt"],
    "cross": ["cross", "crs"], "stn": ["station", "stn"], "way": ["way", "wy"],
    "pk": ["park", "pk"], "vlg": ["village", "vlg", "vill"], "jn": ["junction", "jn", "jct"],
    "fac": ["faubourg", "fg", "fbg"], "ml": ["mill", "ml"], "cv": ["cove", "cv"],
    "pass": ["passage", "pass"],
}
ADDRESS_STOP = [
    "de", "du", "des", "la", "le", "les", "d", "l", "of", "the", "and", "near", "nr", "no", "door", "house", "h", "hno",
    "flat", "unit", "apt", "apartment", "ste", "suite", "fl", "floor", "flr", "pmb", "po", "box", "plot", "cdp", "number",
    "num", "shop", "room", "rm", "dist", "district", "tq", "taluk", "tal", "na", "n/a", "et", "au", "aux", "en", "sur",
    "null", "none", "nan",
]
ORDINAL_WORDS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
    "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
ORDINAL_TENS = {"thirtieth": "30th", "fortieth": "40th", "fiftieth": "50th"}

# States of the United States and of India with their codes, spellings of Indian states, French areas.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
    "district of columbia": "dc",
}
IN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga",
    "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl",
    "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg",
    "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl", "new delhi": "dl",
    "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py", "dilli": "dl", "tamilnatu": "tn",
    "tamilnadu": "tn", "pashcimabang": "wb", "pashcimbang": "wb", "pashchimbang": "wb", "keralam": "kl", "karnatak": "ka",
    "odisa": "od", "telanganaa": "tg", "panjab": "pb", "asam": "as", "hariyan": "hr", "hariyana": "hr", "keralan": "kl",
    "pnjab": "pb", "odish": "od",
}
FR_AREAS = [
    "auvergne rhone alpes", "bourgogne franche comte", "bretagne", "centre val de loire", "corse", "grand est",
    "hauts de france", "ile de france", "normandie", "nouvelle aquitaine", "occitanie", "pays de la loire",
    "provence alpes cote d azur", "paca", "guadeloupe", "martinique", "guyane", "la reunion", "mayotte", "ain", "aisne",
    "allier", "alpes de haute provence", "hautes alpes", "alpes maritimes", "ardeche", "ardennes", "ariege", "aube", "aude",
    "aveyron", "bouches du rhone", "calvados", "cantal", "charente", "charente maritime", "cher", "correze", "corse du sud",
    "haute corse", "cote d or", "cotes d armor", "creuse", "dordogne", "doubs", "drome", "eure", "eure et loir", "finistere",
    "gard", "haute garonne", "gers", "gironde", "herault", "ille et vilaine", "indre", "indre et loire", "isere", "jura",
    "landes", "loir et cher", "loire", "haute loire", "loire atlantique", "loiret", "lot", "lot et garonne", "lozere",
    "maine et loire", "manche", "marne", "haute marne", "mayenne", "meurthe et moselle", "meuse", "morbihan", "moselle",
    "nievre", "nord", "oise", "orne", "pas de calais", "puy de dome", "pyrenees atlantiques", "hautes pyrenees",
    "pyrenees orientales", "bas rhin", "haut rhin", "rhone", "haute saone", "saone et loire", "sarthe", "savoie",
    "haute savoie", "paris", "seine maritime", "seine et marne", "yvelines", "deux sevres", "somme", "tarn",
    "tarn et garonne", "var", "vaucluse", "vendee", "vienne", "haute vienne", "vosges", "yonne", "territoire de belfort",
    "essonne", "hauts de seine", "seine saint denis", "val de marne", "val d oise",
]

# Share of true matches by kind of house-number edit.
EDIT_PRIORS = {"same-len d<=2": 0.193, "same-len d3-50": 0.06, "same-len d>50": 0.52, "prefix": 0.715, "suffix": 0.843, "substring": 0.607, "other": 0.401}

# Group features that rest on a record's own support.
SELF_SUPPORT = ["g_num_me_w", "g_num_me_n", "g_name_me_w", "g_name_me_n", "g_psum_other", "g_n_claim"]


def ordinals() -> dict[str, str]:
    """first -> 1st, ..., and the tens."""
    endings = {1: "st", 2: "nd", 3: "rd"}
    return {w: f"{i}{endings.get(i, 'th')}" for i, w in enumerate(ORDINAL_WORDS, 1)} | ORDINAL_TENS


def address_canon() -> dict[str, str]:
    """Each variant of an address word with its canonical form; a later form wins."""
    return {v: canon for canon, variants in ADDRESS_WORDS.items() for v in variants}
