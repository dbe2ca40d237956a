"""Parameters the registered queries pass to the operators on the driver tables.

Orders span 1995-2001, so the "latest year" is 2001 and the reference's
2020-2024 trend window becomes 1997-2001. Patterns are chosen to hit the
stand-in names (zones are ``NATION_n``, countries are region names).
"""

LATEST_YEAR = 2001
TREND_START, TREND_END = 1997, 2001
# Every type that the tidy access table has (the two sources' recoded types).
ACCESS_TYPES = ("water", "sewer")
FOCUS_ZONE_PATTERN = "nation_1"
FOCUS_COUNTRIES = ["ASIA"]
COMPARE_COUNTRIES = ["ASIA", "AFRICA"]
PRIORITY_COUNTRIES = ["ASIA"]
PRIORITY_ZONE_PATTERNS = ["nation_1"]
PRIORITY_PAIRS = [("EUROPE", "nation_2")]
TOP_N = 3

SERVICE_COUNTRY = "AMERICA"
SERVICE_CITY = "All"
SERVICE_ZONE = "R"
SERVICE_MONTHS = ("1996-03", "1998-10")
SHARE_ZONE = "BUILDING"

LEDGER_RANGE = ("1996-01-01", "2000-12-31")
LEDGER_YEARS = list(range(1995, 2002))
HIST_BINS = 30
AS_OF = "2001-08-01"

CATALOGUE_SEARCH = "bolt|gear"
CATALOGUE_DOMAINS = ["SMALL", "ECONOMY", "STANDARD"]
CATALOGUE_FREQUENCIES = ["Monthly", "Quarterly"]
CATALOGUE_FRAMEWORKS = ["jmp", "amcow"]
FRAMEWORKS = ["jmp", "amcow", "iwa"]
DOCUMENT_SEARCH = "licen[cs]e|copyright"
DOCUMENT_COLUMNS = ["text", "source", "lang"]
# Declared subcategory order of three catalogue sections; other names and sections sort alphabetically after it.
SUBCATEGORY_ORDER = {"Brand#1": ["small", "hot", "absent"], "Brand#12": ["red"], "Brand#13": ["old", "new", "cold"]}
