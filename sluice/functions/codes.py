"""Fixed codes of the filings, and the tables that turn codes into words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Transaction types that move money between registered committees.
TRANSFER_TYPES = (
    "15Z", "16R", "17R", "18G", "18J", "18K", "19J", "22H", "22Z", "24G", "24H", "24I", "24K", "24U", "24Z",
    "30K", "30G", "30F", "31K", "31G", "31F", "32K", "32G", "32F", "40Z", "41Z", "42Z",
)
#: Types whose counterparty is always an unregistered person or organisation.
EARMARK_TYPES = ("15E", "15I", "15T", "24I")
#: Party codes that count as independent.
INDEPENDENT = ("IND", "N", "NPA", "NOP", "NNE", "UN")
#: Parties of rankings and totals, in the order they are shown.
PARTIES = ("ALL", "DEM", "REP", "IND", "OTH", "UNK")
#: Words that are neither indexed nor searched for.
STOP_WORDS = ("for", "the", "of", "", "and", "mr", "mr.", "mrs", "mrs.", "ms.", "to")
#: Titles of ranking lists, of parties and of yearly totals.
LIST_TITLES = {
    "individuals-donor": "Individual Donors",
    "individuals-rec": "Individual Recipients",
    "cmte_tx_data-donor": "Committee Donors",
    "cmte_tx_data-rec": "Committee Recipients",
    "cmte_tx_data-exp": "Committee Spenders",
    "candidates-rec": "Candidate Recipients",
    "candidates-donor": "Candidate Donors",
    "candidates-exp": "Candidate Spenders",
}
PARTY_TITLES = {
    "ALL": "Overall",
    "DEM": "Democrat",
    "REP": "Republican",
    "IND": "Independent",
    "OTH": "Other",
    "UNK": "Unknown",
}
TOTAL_TITLES = {
    "rec": "Funds Received",
    "donor": "Funds Donated or Transferred",
    "exp": "Funds Expensed",
}
#: Designations of committees by code.
DESIGNATIONS = {
    "A": "Authorized by Candidate",
    "B": "Lobbyist/Registrant PAC",
    "D": "Leadership PAC",
    "J": "Joint Fundraiser",
    "P": "Principal Campaign",
    "U": "Unauthorized",
}
#: Kinds of organisations by code.
ORGANISATIONS = {
    "C": "Corporation",
    "L": "Labor Organization",
    "M": "Membership Organization",
    "T": "Trade Association",
    "V": "Cooperative",
    "W": "Corporation without Capital Stock",
}
#: Offices by the first letter of a candidate's id.
OFFICES = {"H": "House", "S": "Senate", "P": "President"}
#: States by code.
STATES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
}
#: Party names by code.
PARTY_NAMES = {
    "ACE": "Ace Party",
    "AKI": "Alaskan Independence Party",
    "AIC": "American Independent Conservative",
    "AIP": "American Independent Party",
    "AMP": "American Party",
    "APF": "American People's Freedom Party",
    "AE": "Americans Elect",
    "CIT": "Citizens' Party",
    "CMD": "Commandments Party",
    "CMP": "Commonwealth Party of the U.S.",
    "COM": "Communist Party",
    "CNC": "Concerned Citizens Party Of Connecticut",
    "CRV": "Conservative Party",
    "CON": "Constitution Party",
    "CST": "Constitutional",
    "COU": "Country",
    "DCG": "D.C. Statehood Green Party",
    "DNL": "Democratic-Nonpartisan League",
    "DEM": "Democratic Party",
    "D/C": "Democratic/Conservative",
    "DFL": "Democratic-Farmer-Labor",
    "DGR": "Desert Green Party",
    "FED": "Federalist",
    "FLP": "Freedom Labor Party",
    "FRE": "Freedom Party",
    "GWP": "George Wallace Party",
    "GRT": "Grassroots",
    "GRE": "Green Party",
    "GR": "Green-Rainbow",
    "HRP": "Human Rights Party",
    "IDP": "Independence Party",
    "IND": "Independent",
    "IAP": "Independent American Party",
    "ICD": "Independent Conservative Democratic",
    "IGR": "Independent Green",
    "IP": "Independent Party",
    "IDE": "Indepenent Party of Delaware",
    "IGD": "Industrial Government Party",
    "JCN": "Jewish/Christian National",
    "JUS": "Justice Party",
    "LRU": "La Raza Unida",
    "LBR": "Labor Party",
    "LFT": "Less Federal Taxes",
    "LBL": "Liberal Party",
    "LIB": "Libertarian Party",
    "LBU": "Liberty Union Party",
    "MTP": "Mountain Party",
    "NDP": "National Democratic Party",
    "NLP": "Natural Law Party",
    "NA": "New Alliance",
    "NJC": "New Jersey Conservative Party",
    "NPP": "New Progressive Party",
    "NPA": "No Party Affiliation",
    "NOP": "No Party Preference",
    "NNE": "None",
    "N": "Nonpartisan",
    "NON": "Non-Party",
    "OE": "One Earth Party",
    "OTH": "Other",
    "PG": "Pacific Green",
    "PSL": "Party for Socialism and Liberation",
    "PAF": "Peace And Freedom",
    "PFP": "Peace And Freedom Party",
    "PFD": "Peace Freedom Party",
    "POP": "People Over Politics",
    "PPY": "People's Party",
    "PCH": "Personal Choice Party",
    "PPD": "Popular Democratic Party",
    "PRO": "Progressive Party",
    "NAP": "Prohibition Party",
    "PRI": "Puerto Rican Independence Party",
    "RUP": "Raza Unida Party",
    "REF": "Reform Party",
    "REP": "Republican Party",
    "RES": "Resource Party",
    "RTL": "Right To Life",
    "SEP": "Socialist Equality Party",
    "SLP": "Socialist Labor Party",
    "SUS": "Socialist Party",
    "SOC": "Socialist Party U.S.A.",
    "SWP": "Socialist Workers Party",
    "TX": "Taxpayers",
    "TWR": "Taxpayers Without Representation",
    "TEA": "Tea Party",
    "THD": "Theo-Democratic",
    "LAB": "U.S. Labor Party",
    "USP": "U.S. People's Party",
    "UST": "U.S. Taxpayers Party",
    "UN": "Unaffiliated",
    "UC": "United Citizen",
    "UNI": "United Party",
    "UNK": "Unknown",
    "VET": "Veterans Party",
    "WTP": "We the People",
    "W": "Write-In",
}
#: Cycles are even years.
CYCLES = tuple(range(1980, 2022, 2))
RANKING_LIMIT = 500
INDIVIDUAL_LIMIT = 100_000
COUNTERPARTY_LIMIT = 100
SHARD_IDS = 1_250
MAX_RESULTS = 500


def code_table(spark: SparkSession, codes: dict[str, str], key: str, value: str) -> DataFrame:
    """A code table as rows; all of them are a few dozen rows."""
    return spark.createDataFrame(list(codes.items()), f"{key} string, {value} string")
