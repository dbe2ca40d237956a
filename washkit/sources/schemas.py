"""Declared schemas of the input tables (DDL strings; no inference)."""

WATER_ACCESS = (
    "country STRING, zone STRING, year STRING, w_safely_managed STRING, w_safely_managed_pct STRING, "
    "w_basic STRING, w_basic_pct STRING, w_limited STRING, w_limited_pct STRING, w_unimproved STRING, "
    "w_unimproved_pct STRING, surface_water STRING, surface_water_pct STRING, w_other_pct STRING, "
    "popn_total STRING, households STRING, municipal_coverage STRING, type STRING"
)
SEWER_ACCESS = (
    "country STRING, zone STRING, year STRING, s_safely_managed STRING, s_safely_managed_pct STRING, "
    "s_basic STRING, s_basic_pct STRING, s_limited STRING, s_limited_pct STRING, s_unimproved STRING, "
    "s_unimproved_pct STRING, open_def STRING, open_def_pct STRING, s_other_pct STRING, "
    "popn_total STRING, households STRING, type STRING"
)
# Access CSVs are read as text and coerced leniently (values such as '07.06' or 'x' occur).

# Typed columns of the tidy access table after normalisation.
ACCESS_COUNT_COLS = ["safely_managed", "basic", "limited", "unimproved", "surface_water", "open_def",
                     "popn_total", "households", "municipal_coverage"]
ACCESS_PCT_COLS = ["safely_managed_pct", "basic_pct", "limited_pct", "unimproved_pct", "surface_water_pct",
                   "open_def_pct", "other_pct"]

SERVICE_MONTH = (
    "country STRING, city STRING, zone STRING, year INT, month INT, households BIGINT, w_supplied DOUBLE, "
    "total_consumption DOUBLE, metered DOUBLE, tests_conducted_chlorine BIGINT, test_passed_chlorine BIGINT, "
    "test_conducted_ecoli BIGINT, tests_passed_ecoli BIGINT, complaints BIGINT, resolved BIGINT, "
    "sewer_connections BIGINT, public_toilets BIGINT"
)

LEDGER = (
    "year INT, month INT, zone STRING, total_operating_revenues DOUBLE, total_operating_expenditures DOUBLE, "
    "collection_efficiency DOUBLE, personnel_expenditure_pct DOUBLE, total_billing DOUBLE, "
    "total_collection DOUBLE, om_cost_coverage DOUBLE"
)
# Source headers of the ledger file, and the snake-case names used inside the library.
LEDGER_RENAME = {
    "Year": "year",
    "Month": "month",
    "Zone": "zone",
    "Total Operating Revenues": "total_operating_revenues",
    "Total Operating Expenditures": "total_operating_expenditures",
    "Collection Efficiency": "collection_efficiency",
    "Personnel Expenditure as Percentage of O&M Costs": "personnel_expenditure_pct",
    "Total Water & Sewerage Billing": "total_billing",
    "Total Collection": "total_collection",
    "Operation & Maintenance Cost Coverage": "om_cost_coverage",
}

BILLING = "customer_id STRING, date DATE, billed DOUBLE, paid DOUBLE"
PRODUCTION = "date DATE, source STRING, production_m3 DOUBLE, service_hours DOUBLE"

CATALOGUE = (
    "domain STRING, indicator STRING, description STRING, frequency STRING, granularity STRING, "
    "jmp STRING, amcow STRING, iwa STRING, cwis_cities STRING, ib_net STRING, section STRING, subcategory STRING"
)
# Display headers of the catalogue's framework columns and their snake-case names.
FRAMEWORK_RENAME = {"JMP": "jmp", "AMCOW": "amcow", "IWA": "iwa", "CWIS Cities": "cwis_cities", "IB Net": "ib_net"}

GEO_POLYGONS = (
    "type STRING, features ARRAY<STRUCT<type: STRING, properties: MAP<STRING, STRING>, "
    "geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>"
)
GEO_POINTS = (
    "type STRING, features ARRAY<STRUCT<type: STRING, properties: MAP<STRING, STRING>, "
    "geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>>>"
)
