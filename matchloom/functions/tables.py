"""Fixed values of the normalisation rules."""

# Business-name abbreviations.
NAME_WORDS = {
    "pvt": "private", "pte": "private", "prvt": "private", "ltd": "limited", "ltda": "limited", "lmt": "limited", "corp": "corporation", "co": "company", "cos": "companies",
    "inc": "incorporated", "incorp": "incorporated", "intl": "international", "int": "international", "mfg": "manufacturing", "mfrs": "manufacturers", "svc": "services", "svcs": "services", "serv": "services",
    "assn": "association", "assoc": "associates", "bros": "brothers", "natl": "national", "ent": "enterprises", "mgmt": "management", "dev": "development", "grp": "group",
    "ind": "industries", "inds": "industries", "eng": "engineering", "engg": "engineering", "tech": "technologies", "cie": "compagnie", "ste": "societe", "sa": "sa",
}

# Address abbreviations.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "bvd": "boulevard", "dr": "drive", "ln": "lane", "hwy": "highway",
    "pkwy": "parkway", "ct": "court", "pl": "place", "cir": "circle", "sq": "square", "ter": "terrace", "trl": "trail", "fwy": "freeway", "expy": "expressway", "ste": "suite", "apt": "apartment",
    "fl": "floor", "flr": "floor", "bldg": "building", "rm": "room", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "mt": "mount", "ft": "fort", "hts": "heights", "nr": "near", "opp": "opposite", "stn": "station", "clny": "colony", "ngr": "nagar", "mkt": "market", "vill": "village", "vil": "village",
    "dist": "district", "distt": "district", "po": "post office", "ps": "police station", "r": "rue", "rte": "route", "ch": "chemin", "imp": "impasse", "fbg": "faubourg", "all": "allee", "pt": "point",
}

# Postal codes of the states of the US.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland",
    "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey",
    "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina",
    "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
    "dc": "district of columbia",
}

# Legal forms and stop words left out of a name's core.
LEGAL_WORDS = (
    "private", "limited", "corporation", "company", "companies", "incorporated", "llc", "llp", "lp", "plc", "pllc", "pc", "opc", "the", "and", "of", "sas", "sasu", "sarl", "eurl", "sa", "sci", "snc", "scop",
    "compagnie", "societe", "fils", "et", "de", "des", "du", "la", "le", "les", "dba", "aka", "group", "holdings",
)

# The four-entry tables of the small feature set.
SHORT_NAME_WORDS = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated"}
SHORT_ADDRESS_WORDS = {"rd": "road", "ave": "avenue", "blvd": "boulevard", "apt": "apartment"}
