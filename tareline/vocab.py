"""Code lists, labels and patterns the results depend on."""

from __future__ import annotations

# Preservation state codes and labels; other codes become "none".
STATES = {
    "ALI": "Alive",
    "FRE": "Fresh",
    "FRO": "Frozen",
    "SAL": "Salted",
}

# Presentation codes and labels; other codes become "none".
PRESENTATIONS = {
    "CBF": "cod butterfly",
    "CLA": "claws",
    "DWT": "gilled, gutted, partly headed, fins off",
    "FIL": "filleted",
    "FIS": "filleted, skinned",
    "FSB": "filleted, with skin and bones on",
    "FSP": "filleted, skinned, with pinbone on",
    "GHT": "gutted, headed, tail off",
    "GTA": "gutted, tail off",
    "GTF": "gutted, tail off, finned",
    "GUG": "gutted, gilled",
    "GUH": "gutted and headed",
    "GUS": "gutted, headed, skinned",
    "GUT": "gutted",
    "HEA": "headed",
    "HET": "headed, tail off",
    "JAP": "Japanese cut",
    "JAT": "Japanese cut, tail off",
    "LAP": "Lappen",
    "SAD": "salted dry",
    "SAL": "salted wet light",
    "SGH": "salted, gutted, headed",
    "SGT": "salted, gutted",
    "SUR": "surimi",
    "TAL": "tail only (squid)",
    "TLD": "tail off",
    "TUB": "tube only (squid)",
    "WHL": "whole",
    "WNG": "wings only",
    "WNG+SKI": "wings only, skinned",
}

UNKNOWN = "none"

# Fixed patterns: state named in a processing description, first match wins.
STATE_RULES = [
    (r"\blive\b|alive", "Alive"),
    (r"fresh", "Fresh"),
    (r"frozen", "Frozen"),
    (r"salted", "Salted"),
]

# Presentations that are totals over other presentations.
PRESENTATION_TOTALS = ["All presentation forms", "Dried", "Fresh", "Frozen", "Salted"]

# Member states of the bloc (ISO 3166-1 alpha-3) by view.
MEMBERS = [
    "AUT", "BEL", "BGR", "HRV", "CYP", "CZE", "DNK", "EST", "FIN",
    "FRA", "DEU", "GRC", "HUN", "IRL", "ITA", "LVA", "LTU", "LUX",
    "MLT", "NLD", "POL", "PRT", "ROU", "SVK", "SVN", "ESP", "SWE",
]
MEMBER_VIEWS = {
    "members": MEMBERS,
    "with_gbr": [*MEMBERS, "GBR"],
    "with_nor": [*MEMBERS, "NOR"],
}
WIDE_CODE = "EU"

# Labels written into result columns.
WIDE_CF = "EU-wide CF"
NATIONAL_CF = "national CF"
WIDE_AVAILABLE = "EU-wide CF value available"
NOT_AVAILABLE = "not available"
NOT_LANDED = "not landed"
NO_NATIONAL_CF = "no national CF value"
NO_WIDE_CF = "no EU-wide CF value"

# Notes, sources and rows with a special role when factors are compiled.
DEFERRING_NOTES = ["see list of CCF", "see ICCAT website"]
PREFERRED_SOURCES = ["EU Council Regulations Annex", "EU Council Website Third Country Info"]
EXCLUDED_SOURCE = "EUMOFA Appendix 7"
EXCLUDED_TYPE = "Aquatic plants"
SUPERSEDED_ROW = {
    "country": "Spain",
    "common_name": "Ling",
    "type_of_processing": "frozen, fillets",
}

# Short names of factor sources, first match wins.
SOURCE_RULES = [
    (r"EU Council Regulations", "EU Council"),
    (r"FAO", "FAO"),
    (r"Third Country", "National Fisheries Authority"),
]

# Unit and use of the landings the jobs work on.
PRODUCT_WEIGHT = "Tonnes product weight"
LIVE_WEIGHT = "Tonnes live weight"
UNIT_PRICE = "Euro per tonne"
TOTAL_USE = "Total"

# Fixed patterns: presentations too vague to hold one factor.
VAGUE_PATTERNS = [
    "Fresh, not specified",
    "Frozen, not specified",
    "Salted, not specified",
    "Presentation unknown",
    "Dried, whole",
    "Dried, gutted and headed",
    "Frozen, not filleted",
]

# Labels that replace dictionary labels.
RELABELLED_COUNTRIES = {
    "Germany (until 1990 former territory of the FRG)": "Germany",
}
RELABELLED_ISO2 = {"GB": "UK"}

# Fixed patterns: preparation named in a processing description; the last match
# wins and "liver" takes back what "live" set.
PREPARATION_RULES = [
    ("live", "live"),
    ("liver", None),
    ("fresh", "fresh"),
    ("frozen", "frozen"),
    ("dried|canned|fermented|pickled|preserved|salted|brine|smoked", "preserved"),
]

# Descriptions that name a preparation only and stand for whole products.
WHOLE_DESCRIPTIONS = [
    "fresh/chilled",
    "frozen",
    "salted, wet or in brine",
    "salted wet light",
    "salted dry light",
    "salted wet heavy",
    "salted dry heavy, hand processed",
    "smoked",
    "salted",
    "salted dry heavy",
    "dried, whether or not salted",
    "dried",
    "live",
]

# Fixed patterns: separation named in a processing description, the last match wins.
SEPARATION_RULES = [
    ("gutted|head off|tail off", "whole"),
    ("^canned$", "other meat"),
    ("gibbed|surimi|blocks|edible flesh|meat|minced|paste|steak|split|skin off|dressed|boneless", "other meat"),
    ("roe|liver", "livers and roes"),
    ("caviar", "caviar"),
    ("tails only|wings only|tail only", "other body parts"),
]
FILLET = "fillet"
NOT_FILLET = "blocks"
BONELESS = "boneless"
FISH_TYPE = "Fishes"
NON_FISH_SEPARATION = "non-fish, non-fmp form"

# Misspelt, hybrid and outdated taxon names and the name to use.
TAXON_FIXES = {
    "alosa alosa, a. fallax": "alosa",
    "xiphopenaeus, trachypenaeus spp": "penaeidae",
    "loliginidae, ommastrephidae": "teuthida",
    "squalidae, scyliorhinidae": "carcharhiniformes",
    "merluccius capensis, m. paradox": "merluccius",
    "thunnini": "scombridae",
    "sepildae, sepiolidae": "sepiidae",
    "acipenser gueidenstaedtii": "acipenser gueldenstaedtii",
    "dicentrachurus labrax": "dicentrarchus labrax",
    "sebastes marinus": "sebastes norvegicus",
    "microcosmus suicatus": "microcosmus sulcatus",
    "pectin maximus": "pecten maximus",
    "illex ilecebrosus": "illex illecebrosus",
    "chionectes opilio": "chionoecetes opilio",
    "urophycis chruss": "urophycis chuss",
    "argyrosomus holoiepidotus": "argyrosomus hololepidotus",
    "dicentrachurus punctatus": "dicentrarchus punctatus",
    "nototodarus sloania": "nototodarus sloanii",
    "psette maxima": "psetta maxima",
    "aridae": "ariidae",
    "carinus maenas": "carcinus maenas",
    "catharidae": "citharidae",
    "dicentrachurus": "dicentrarchus",
    "galdropsarus": "gaidropsarus",
    "holothurioidea": "holothuroidea",
    "lophidae": "lophiidae",
    "mytillidae": "mytilidae",
    "salmonoidei": "salmonidae",
    "brachyura": "portunidae",
    "branchiostegidae": "malacanthidae",
}

# Taxa of common names that a name table cannot settle.
COMMON_NAME_TAXA = {
    "Akiami paste shrimp": "acetes japonicus",
    "Carp": "cyprinidae",
    "Catfish": "siluriformes",
    "Characins": "characidae",
    "Cichlids": "cichlidae",
    "Chilean hake": "merluccius",
    "Cod": "gadus",
    "Common carp": "cyprinus carpio",
    "Crab": "portunidae",
    "Crustaceans": "decapoda",
    "Cyprinids nei": "cyprinidae",
    "Eel": "anguilla",
    "Filefishes": "monacanthidae",
    "Hairtails, cutlassfishes": "trichiuridae",
    "Indian mackerels nei": "rastrelliger",
    "Indian oil sardine": "sardinella",
    "Indian scad": "decapterus",
    "king) mackerel": "scomberomorus",
    "Klipfish": "clinidae",
    "Lobster": "nephropidae",
    "Mackerel": "scombridae",
    "Molluscs": "mollusca",
    "Other crabs": "cancridae",
    "Other crustaceans": "decapoda",
    "Pacific saury": "scomberesox scombroides",
    "Pike": "esox",
    "Pilchard": "clupeidae",
    "Sardine": "clupeidae",
    "Sardinellas nei": "clupeidae",
    "Sea bream": "sparidae",
    "Shark": "carcharhiniformes",
    "Sharks": "carcharhiniformes",
    "Shrimp and prawns": "penaeus",
    "Shrimps": "penaeus",
    "Sprat": "sprattus",
    "Tilapia": "oreochromis",
    "Tilapias nei": "oreochromis",
}

# Common names too general to stand for a taxon.
TOO_GENERAL = [
    "Freshwater fish", "Other fish", "Sea bass", "Other shellfish",
    "Marine fishes", "Ornamental fish", "Fishes",
]

# Spellings in processing descriptions.
GUTTED_MISSPELT = "guttted"
GUTTED = "gutted"
SKINLESS_FILLETS = "fillets, skinless"
MOLLUSCS = "Molluscs"
UNKNOWN_PROCESSING = "unknown"

# Code prefix and separation of caviar.
CAVIAR_CODE = "^16043"
CAVIAR = "caviar"

# Spellings of countries (lower case) that stand for another name, and the name to show.
COUNTRY_SPELLINGS = {
    "faeroe islands": ("faroe islands", "Faroe Islands"),
    "uk": ("united kingdom", "UK"),
    "usa": ("united states", "USA"),
}

# Codes and continents that no list of countries gives: the bloc's own, and Greenland counted as European.
COUNTRY_OVERRIDES = {
    "eu": {"country": "EU", "iso3c": "EU", "iso2c": "EU", "continent": "Europe"},
    "greenland": {"continent": "Europe"},
}

# Countries of the spread examples by lower-case spelling, and the name to show.
SPREAD_COUNTRIES = {
    "bulg": "Bulgaria",
    "china, h. kong": "Hong Kong",
    "eu": "EU",
    "faeroe islands": "Faroe Islands",
    "korea rep": "Korea",
    "russian federation": "Russia",
    "uk": "UK",
    "usa": "USA",
}

# Common names to show in the spread examples; the last one for any name with this word in it.
SPREAD_COMMON_NAMES = {
    "Angler(=Monk)": "Monkfish",
    "Ling": "Common ling",
    "Saithe(=Pollock)": "Saithe",
    "Atlantic redfishes nei": "Atlantic redfishes",
}
DOGFISH, DOGFISH_NAME = "dogfish", "Piked dogfish"

# Rows and labels that the spread examples leave out, as their factors are in error or said twice.
SPREAD_EXCLUSIONS = [
    {"scientific_name": "clupea harengus", "type_of_processing": "fresh/chilled"},
    {"scientific_name": "lepidorhombus"},
]
SPREAD_EXCLUDED_LABELS = ["Greenland halibut (frozen)"]

# Countries of the spread examples that are not members.
SPREAD_NON_MEMBERS = ["Greenland", "Iceland", "Norway", "Russia", "UK"]
