"""Explicit schemas. Codes keep their leading zeros, so nothing is ever inferred."""

from __future__ import annotations

CASES = (
    "ID string, CNTYFIPS string, State string, Solved string, Year int, VicAge int, VicSex string, "
    "VicRace string, VicCount int, OffAge int, OffSex string, OffRace string, Weapon string"
)
CODES = "ID string, CNTYFIPS string"
INCIDENTS = CASES + ", county_fips string"
COUNTIES = "GEOID string, STATEFP string, geometry binary"
STATES = "State_Name string, st_fips string, Abbrev string"
# --- JSON documents ---------------------------------------------------------------------------------
PAIR_DOCUMENT = "struct<error:array<string>,result:map<string,struct<altname:string,base:string>>>"
# the result object mixes price arrays with one plain number, so its values stay JSON text at first
OHLC_DOCUMENT = "struct<error:array<string>,result:map<string,string>>"
OHLC_ROWS = "array<array<string>>"
LISTINGS_DOCUMENT = (
    "struct<data:array<struct<id:bigint,name:string,symbol:string,slug:string,date_added:string,"
    "max_supply:double,circulating_supply:double,total_supply:double,quote:struct<USD:struct<"
    "price:double,volume_24h:double,percent_change_1h:double,percent_change_24h:double,"
    "percent_change_7d:double,percent_change_30d:double,percent_change_60d:double,"
    "percent_change_90d:double,market_cap:double,market_cap_dominance:double,last_updated:string>>>>>"
)
