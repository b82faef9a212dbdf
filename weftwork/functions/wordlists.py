"""Word lists of the cleaning rules."""

# Address words and their short forms.
ADDRESS_WORDS = {
    "alley": "aly", "apartment": "apt", "avenue": "ave", "av": "ave", "avn": "ave", "boulevard": "blvd", "bd": "blvd", "boul": "blvd",
    "building": "bldg", "center": "ctr", "centre": "ctr", "circle": "cir", "court": "ct", "cove": "cv", "crossing": "xing", "drive": "dr",
    "east": "e", "expressway": "expy", "floor": "fl", "fort": "ft", "freeway": "fwy", "heights": "hts", "highway": "hwy", "junction": "jct",
    "lane": "ln", "loop": "loop", "mount": "mt", "north": "n", "parkway": "pkwy", "path": "path", "pike": "pike", "pky": "pkwy",
    "place": "pl", "point": "pt", "ridge": "rdg", "road": "rd", "run": "run", "saint": "st", "south": "s", "square": "sq", "str": "st",
    "street": "st", "suite": "ste", "terrace": "ter", "trail": "trl", "way": "wy", "west": "w",
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
    "allee": "all", "bis": "bis", "chemin": "ch", "cours": "crs", "impasse": "imp", "quai": "qu", "r": "rue", "residence": "res", "route": "rte",
    "bangalore": "bengaluru", "bombay": "mumbai", "calcutta": "kolkata", "colony": "col", "gurgaon": "gurugram", "keralam": "kerala",
    "madras": "chennai", "marg": "mg", "nagar": "ngr", "near": "nr", "opp": "opp", "opposite": "opp", "sector": "sec",
}

# States of the US and their codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va",
    "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}

# States and territories of India and their codes.
INDIAN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chandigarh": "ch", "chhattisgarh": "cg", "delhi": "dl",
    "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jammu and kashmir": "jk", "jharkhand": "jh", "karnataka": "ka",
    "kerala": "kl", "ladakh": "la", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz",
    "nagaland": "nl", "new delhi": "dl", "odisha": "od", "orissa": "od", "pondicherry": "py", "puducherry": "py", "punjab": "pb",
    "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk",
    "west bengal": "wb",
}

# Words of names and their common form.
NAME_WORDS = {
    "&": "&", "and": "&", "associates": "associate", "brothers": "bros", "co": "co", "company": "co", "corp": "corp", "corporation": "corp",
    "enterprises": "enterprise", "group": "group", "holdings": "holding", "inc": "inc", "incorporated": "inc", "industries": "industry",
    "international": "intl", "intl": "intl", "limited": "ltd", "llc": "llc", "llp": "llp", "ltd": "ltd", "private": "pvt", "pvt": "pvt",
    "services": "service", "shree": "shree", "shri": "shree", "solutions": "solution", "sri": "shree", "systems": "system",
    "tech": "technology", "technologies": "technology", "the": "the",
}

# Legal forms (in the common form), and fillers; neither is part of the core of a name.
LEGAL_WORDS = (
    "& c cie co corp eurl gmbh inc l llc llp lp ltd opc p pa pc plc pllc pvt sa sarl sas sasu sci snc the".split()
)
FILLER_WORDS = "associate center company ctr enterprise fils group holding partners service services solution".split()
#: Legal forms that say nothing when two are compared.
WEAK_LEGAL = "& the l p c".split()
