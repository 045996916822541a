"""Country names and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from psephos.functions.nulls import clean_text

# Codes and names of the countries that surveys and the party table cover.
#: Three-letter code by two-letter code.
ISO3 = {
    "AL": "ALB", "AT": "AUT", "BA": "BIH", "BE": "BEL", "BG": "BGR", "CH": "CHE", "CY": "CYP", "CZ": "CZE", "DE": "DEU", "DK": "DNK", "EE": "EST",
    "ES": "ESP", "FI": "FIN", "FR": "FRA", "GB": "GBR", "GR": "GRC", "HR": "HRV", "HU": "HUN", "IE": "IRL", "IL": "ISR", "IS": "ISL", "IT": "ITA",
    "LT": "LTU", "LU": "LUX", "LV": "LVA", "ME": "MNE", "MK": "MKD", "NL": "NLD", "NO": "NOR", "PL": "POL", "PT": "PRT", "RO": "ROU", "RS": "SRB",
    "RU": "RUS", "SE": "SWE", "SI": "SVN", "SK": "SVK", "TR": "TUR", "UA": "UKR",
}
#: Name by two-letter code.
NAMES = {
    "AL": "Albania", "AT": "Austria", "BA": "Bosnia-Herzegovina", "BE": "Belgium", "BG": "Bulgaria", "CH": "Switzerland", "CY": "Cyprus",
    "CZ": "Czech Republic", "DE": "Germany", "DK": "Denmark", "EE": "Estonia", "ES": "Spain", "FI": "Finland", "FR": "France",
    "GB": "United Kingdom", "GR": "Greece", "HR": "Croatia", "HU": "Hungary", "IE": "Ireland", "IL": "Israel", "IS": "Iceland", "IT": "Italy",
    "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "ME": "Montenegro", "MK": "North Macedonia", "NL": "Netherlands", "NO": "Norway",
    "PL": "Poland", "PT": "Portugal", "RO": "Romania", "RS": "Serbia", "RU": "Russia", "SE": "Sweden", "SI": "Slovenia", "SK": "Slovakia",
    "TR": "Turkey", "UA": "Ukraine",
}
#: Two-letter code by the name that the party table uses.
CODES = {
    "Albania": "AL", "Austria": "AT", "Azerbaijan": "AZ", "Belarus": "BY", "Belgium": "BE", "Bosnia-Herzegovina": "BA", "Bulgaria": "BG",
    "Canada": "CA", "Chile": "CL", "Colombia": "CO", "Costa Rica": "CR", "Croatia": "HR", "Cyprus": "CY", "Czech Republic": "CZ", "Denmark": "DK",
    "Dominican Republic": "DO", "Ecuador": "EC", "Estonia": "EE", "Finland": "FI", "France": "FR", "Georgia": "GE",
    "German Democratic Republic": "DD", "Germany": "DE", "Greece": "GR", "Hungary": "HU", "Iceland": "IS", "Ireland": "IE", "Israel": "IL",
    "Italy": "IT", "Japan": "JP", "Latvia": "LV", "Lithuania": "LT", "Luxembourg": "LU", "Malta": "MT", "Mexico": "MX", "Moldova": "MD",
    "Montenegro": "ME", "Netherlands": "NL", "New Zealand": "NZ", "North Macedonia": "MK", "Northern Ireland": "GB", "Norway": "NO", "Panama": "PA",
    "Poland": "PL", "Portugal": "PT", "Romania": "RO", "Russia": "RU", "Serbia": "RS", "Slovakia": "SK", "Slovenia": "SI", "South Africa": "ZA",
    "South Korea": "KR", "Spain": "ES", "Sweden": "SE", "Switzerland": "CH", "Turkey": "TR", "Ukraine": "UA", "United Kingdom": "GB",
    "United States": "US",
}


def _looked_up(known: dict[str, str], x: Column | str) -> Column:
    pairs = F.create_map(*(F.lit(v) for pair in known.items() for v in pair))
    return F.coalesce(F.try_element_at(pairs, clean_text(x)), F.lit(""))


def iso2_of_country(name: Column | str) -> Column:
    """The two-letter code of a country by its exact name; empty if unknown."""
    return _looked_up(CODES, name)


def iso3_of_iso2(code: Column | str) -> Column:
    return _looked_up(ISO3, code)


def country_of_iso2(code: Column | str) -> Column:
    return _looked_up(NAMES, code)
