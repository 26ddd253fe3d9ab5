"""Labels, codes and names that results must agree on."""

from __future__ import annotations

# --- case outcome -------------------------------------------------------------------------------
SOLVED, UNSOLVED, ALL = 1, 0, 2
OUTCOME_LABEL = {SOLVED: "Yes", UNSOLVED: "No"}

# --- people -------------------------------------------------------------------------------------
SEXES = ("Female", "Male", "Unknown")

RACES = (
    "White",
    "American Indian or Alaskan Native",
    "Black",
    "Asian",
    "Unknown",
    "Native Hawaiian or Pacific Islander",
)

# column prefix per race
RACE_KEY = {
    "White": "white",
    "American Indian or Alaskan Native": "ai_an",
    "Black": "black",
    "Asian": "asian",
    "Unknown": "unknown_race",
    "Native Hawaiian or Pacific Islander": "nh_pi",
}

# short race names on charts; the recent-years table spells one of them differently
CHART_RACE = {
    "American Indian or Alaskan Native": "A.I./A.N.",
    "Native Hawaiian or Pacific Islander": "N.H./P.I.",
}
RECENT_CHART_RACE = {
    "American Indian or Alaskan Native": "A.I./N.A.",
    "Native Hawaiian or Pacific Islander": "N.H./P.I.",
}

# --- ages ---------------------------------------------------------------------------------------
AGE_RANGES = ("<1", "1-9", "10-19", "20-29", "30-39", "40-49", "50-59", "60-69", "70+", "Unknown")
AGE_UNKNOWN = 999
AGE_LIMIT = 555

# --- weapons: stored label -> name in the report table --------------------------------------------
WEAPONS = {
    "Handgun - pistol, revolver, etc": "Handgun",
    "Knife or cutting instrument": "Knife or Cutting Instrument",
    "Other or type unknown": "Other",
    "Explosives": "Explosives",
    "Blunt object - hammer, club, etc": "Blunt Object",
    "Firearm, type not stated": "Firearm, type not stated",
    "Rifle": "Rifle",
    "Shotgun": "Shotgun",
    "Personal weapons, includes beating": "Personal Weapons, includes beating",
    "Strangulation - hanging": "Strangulation - hanging",
    "Pushed or thrown out window": "Pushed or thrown out window",
    "Fire": "Fire",
    "Narcotics or drugs, sleeping pills": "Narcotics or drugs, sleeping pills",
    "Drowning": "Drowning",
    "Other gun": "Other gun",
    "Asphyxiation - includes death by gas": "Asphyxiation - includes death by gas",
    "Poison - does not include gas": "Poison - does not include gas",
}

# --- places that get no report --------------------------------------------------------------------
NOT_REPORTED = ("District of Columbia", "PAPSP8")

# --- market -----------------------------------------------------------------------------------------
LEGACY_TICKER = {"XXBT": "BTC", "XETH": "ETH"}
LOOKBACK_WEEKS = 200
FIRST_OLDER_WEEK_50 = 51
FIRST_OLDER_WEEK_100 = 100
LISTINGS_FOR_MARKET = 100
EST_OFFSET_SECONDS = -5 * 3600

# --- column titles of the printed tables -----------------------------------------------------------
TITLES = {
    "case_outcome": {"case_outcome": "Case Outcome", "total": "Total"},
    "victim_sex": {"victim_sex": "Victim Sex", "total": "Total"},
    "offender_sex": {"offender_sex": "Offender Sex", "total": "Offender Total"},
    "solve_rate_by_race": {
        "VicRace": "Victim Race",
        "unsolved": "Unsolved",
        "solved": "Solved",
        "solve_rate": "Solve Rate",
    },
    "race_sex": {"race": "Race", "sex": "Sex", "count": "Count"},
    "race_sex_table": {
        "race": "Race",
        "female": "Female",
        "male": "Male",
        "unknown": "Unknown",
        "total": "Total",
        "pct_of_unsolved": "% of Unsolved Total",
    },
    "weapons": {
        "weapon": "Murder Weapon",
        "count": "Count",
        "pct_of_unsolved": "Percent of Unsolved",
    },
    "top_counties": {"county": "County", "unsolved": "Unsolved Homicide Count"},
    "all_counties": {"county": "County", "unsolved": "Unsolved Homicide Count"},
    "county_by_year": {"county": "County", "unsolved_total": "Unsolved Total"},
    "county_map": {"county_total": "County Total", "unsolved": "County Unsolved"},
    "average_table": {
        "asset": "Asset",
        "current_price": "Current Price",
        "avg_50": "50 Week Average",
        "avg_100": "100 Week Average",
    },
    "market_table": {
        "coin": "Coin",
        "ticker": "Ticker",
        "price": "Price",
        "volume_24h": "Volume 24H",
        "volume_change_24h": "Volume Change 24H",
        "pct_change_1h": "% Change 1H",
        "pct_change_24h": "% Change 24H",
        "pct_change_7d": "% Change 7D",
        "pct_change_30d": "% Change 30D",
        "market_cap": "Market Cap",
        "market_cap_dominance": "Market Cap Dominance",
    },
}
