"""Survey codes, names, universes, index membership, states, bands, seasons.

These are published identifiers and constants that results depend on, stated as plain text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: survey variables by endpoint, with the column name each is given -----------
DETAIL_NAMES = """
B17021_001E pov_universe
B17021_002E pov_below_related_children
B17021_003E pov_below_other
B19001_002E hh_income_lt10k
B19001_017E hh_income_ge200k
B19113_001E median_family_income
B19301_001E per_capita_income
B23025_003E labor_force
B23025_005E unemployed
B15003_001E educ_universe
B15003_002E educ_no_schooling
B15003_003E educ_nursery
B15003_004E educ_kindergarten
B15003_005E educ_grade1
B15003_006E educ_grade2
B15003_007E educ_grade3
B15003_008E educ_grade4
B15003_009E educ_grade5
B15003_010E educ_grade6
B15003_011E educ_grade7
B15003_012E educ_grade8
B15003_013E educ_grade9
B15003_014E educ_grade10
B15003_015E educ_grade11
B15003_016E educ_grade12_no_diploma
B15003_017E educ_hs_diploma
B15003_018E educ_ged
B15003_019E educ_some_college_lt1yr
B15003_020E educ_some_college_ge1yr
B15003_021E educ_associates
B15003_022E educ_bachelors
B15003_023E educ_masters
B15003_024E educ_professional_degree
B15003_025E educ_doctorate
B16005_001E lang_universe
B16005_007E lep_spanish_native_not_well
B16005_008E lep_spanish_native_not_at_all
B16005_012E lep_spanish_foreign_not_well
B16005_013E lep_spanish_foreign_not_at_all
B16005_017E lep_indo_euro_native_not_well
B16005_018E lep_indo_euro_native_not_at_all
B16005_022E lep_indo_euro_foreign_not_well
B16005_023E lep_indo_euro_foreign_not_at_all
B16005_029E lep_asian_pac_native_not_well
B16005_030E lep_asian_pac_native_not_at_all
B16005_034E lep_asian_pac_foreign_not_well
B16005_035E lep_asian_pac_foreign_not_at_all
B16005_039E lep_other_native_not_well
B16005_040E lep_other_native_not_at_all
B16005_044E lep_other_foreign_not_well
B16005_045E lep_other_foreign_not_at_all
C24010_001E occ_universe
C24010_019E occ_male_mgmt_business_science_arts
C24010_020E occ_male_business_financial
C24010_021E occ_male_computer_engineering_science
C24010_022E occ_male_education_legal_arts
C24010_023E occ_male_healthcare_practitioners
C24010_024E occ_male_service
C24010_025E occ_male_sales_office
C24010_039E occ_female_mgmt_business_science_arts
C24010_040E occ_female_business_financial
C24010_041E occ_female_computer_engineering_science
C24010_042E occ_female_education_legal_arts
C24010_043E occ_female_healthcare_practitioners
C24010_044E occ_female_service
C24010_045E occ_female_sales_office
B25064_001E median_gross_rent
B25077_001E median_home_value
B25003_001E tenure_universe
B25003_002E owner_occupied_units
B25014_001E occupants_per_room_universe
B25014_005E overcrowded_owner_1_to_1_5_per_room
B25014_006E overcrowded_owner_1_5_to_2_per_room
B25014_007E overcrowded_owner_2plus_per_room
B25040_001E heating_fuel_universe
B25040_003E heating_fuel_utility_gas
B25044_001E vehicle_availability_universe
B25044_003E owner_occupied_no_vehicle
B25044_010E renter_occupied_no_vehicle
B25047_001E plumbing_universe
B25047_002E incomplete_plumbing
B26001_001E group_quarters_pop
"""

PROFILE_NAMES = """
DP03_0009PE unemployment_pct
DP05_0001E total_pop
DP05_0019PE age_lte17_pct
DP05_0079E nh_white_alone
DP02_0001E total_households
DP02_0007PE single_parent_male_hh_pct
DP02_0011PE single_parent_female_hh_pct
DP02_0072PE disability_pct
DP04_0012PE structures_10_19_units_pct
DP04_0013PE structures_20plus_units_pct
DP04_0014PE mobile_homes_pct
DP04_0047PE renter_occupied_pct
DP04_0058PE no_vehicle_pct
DP04_0078PE overcrowded_owner_pct
DP04_0079PE overcrowded_renter_pct
"""

SUBJECT_NAMES = """
S1701_C01_001E pov_determination_universe
S1701_C01_040E pct_below_150pct_poverty
S1701_C02_001E pct_below_100pct_poverty
S0601_C01_001E pop_25plus
S0601_C01_033E no_hs_diploma_pct
S2503_C01_001E renter_units_universe
S2503_C01_028E rent_30_34pct_of_income
S2503_C01_032E rent_35_39pct_of_income
S2503_C01_036E rent_40_49pct_of_income
S2503_C01_040E rent_50plus_pct_of_income
S2701_C05_001E uninsured_pct
S0101_C02_030E age_65plus_pct
S2301_C04_001E not_in_labor_force_pct
"""

# --- Fixed values: universe of each count, and the counts taken as its percentage -------------
# `count=name` gives a name of its own; otherwise `_pct` is appended to the count's name.
UNIVERSES = """
pov_universe: pov_below_related_children pov_below_other
total_households: hh_income_lt10k hh_income_ge200k
educ_universe: educ_no_schooling educ_nursery educ_kindergarten educ_grade1 educ_grade2 educ_grade3
educ_universe: educ_grade4 educ_grade5 educ_grade6 educ_grade7 educ_grade8 educ_grade9 educ_grade10
educ_universe: educ_grade11 educ_grade12_no_diploma educ_hs_diploma educ_ged
educ_universe: educ_some_college_lt1yr educ_some_college_ge1yr educ_associates educ_bachelors
educ_universe: educ_masters educ_professional_degree educ_doctorate
lang_universe: lep_spanish_native_not_well lep_spanish_native_not_at_all
lang_universe: lep_spanish_foreign_not_well lep_spanish_foreign_not_at_all
lang_universe: lep_indo_euro_native_not_well lep_indo_euro_native_not_at_all
lang_universe: lep_indo_euro_foreign_not_well lep_indo_euro_foreign_not_at_all
lang_universe: lep_asian_pac_native_not_well lep_asian_pac_native_not_at_all
lang_universe: lep_asian_pac_foreign_not_well lep_asian_pac_foreign_not_at_all
lang_universe: lep_other_native_not_well lep_other_native_not_at_all
lang_universe: lep_other_foreign_not_well lep_other_foreign_not_at_all
occ_universe: occ_male_mgmt_business_science_arts occ_male_business_financial
occ_universe: occ_male_computer_engineering_science occ_male_education_legal_arts
occ_universe: occ_male_healthcare_practitioners occ_male_service occ_male_sales_office
occ_universe: occ_female_mgmt_business_science_arts occ_female_business_financial
occ_universe: occ_female_computer_engineering_science occ_female_education_legal_arts
occ_universe: occ_female_healthcare_practitioners occ_female_service occ_female_sales_office
tenure_universe: owner_occupied_units=owner_occupied_pct
occupants_per_room_universe: overcrowded_owner_1_to_1_5_per_room
occupants_per_room_universe: overcrowded_owner_1_5_to_2_per_room overcrowded_owner_2plus_per_room
heating_fuel_universe: heating_fuel_utility_gas
vehicle_availability_universe: owner_occupied_no_vehicle renter_occupied_no_vehicle
plumbing_universe: incomplete_plumbing
total_pop: group_quarters_pop=group_quarters_pct nh_white_alone=nh_white_pct
renter_units_universe: rent_30_34pct_of_income=cost_burdened_rent_30_34_pct
renter_units_universe: rent_35_39pct_of_income=cost_burdened_rent_35_39_pct
renter_units_universe: rent_40_49pct_of_income=cost_burdened_rent_40_49_pct
renter_units_universe: rent_50plus_pct_of_income=cost_burdened_rent_50plus_pct
"""

# --- Fixed values: columns dropped once the percentages exist ---------------------------------
DROPPED_AFTER_SHARES = """
pov_universe pov_determination_universe educ_universe pop_25plus lang_universe occ_universe
tenure_universe occupants_per_room_universe heating_fuel_universe vehicle_availability_universe
plumbing_universe renter_units_universe labor_force unemployed
"""

# --- Fixed values: composite indicators. `any` skips missing parts, `all` needs every part ----
# The "less than 9th grade" list ends at grade 7, as published with the study.
COMPOSITES = """
any lep_total_pct = lep_*_pct
all single_parent_pct = single_parent_male_hh_pct single_parent_female_hh_pct
all crowded_housing_pct = overcrowded_owner_pct overcrowded_renter_pct
all multi_unit_housing_pct = structures_10_19_units_pct structures_20plus_units_pct
any housing_cost_burdened_pct = cost_burdened_rent_*_pct
all pov_total_pct = pov_below_related_children_pct pov_below_other_pct
any educ_lt9th_grade_pct = educ_no_schooling_pct educ_nursery_pct educ_kindergarten_pct educ_grade1_pct educ_grade2_pct educ_grade3_pct educ_grade4_pct educ_grade5_pct educ_grade6_pct educ_grade7_pct
any educ_hs_or_higher_pct = educ_hs_diploma_pct educ_ged_pct educ_some_college_lt1yr_pct educ_some_college_ge1yr_pct educ_associates_pct educ_bachelors_pct educ_masters_pct educ_professional_degree_pct educ_doctorate_pct
any educ_lt12th_grade_pct = educ_no_schooling_pct educ_nursery_pct educ_kindergarten_pct educ_grade1_pct educ_grade2_pct educ_grade3_pct educ_grade4_pct educ_grade5_pct educ_grade6_pct educ_grade7_pct educ_grade8_pct educ_grade9_pct educ_grade10_pct educ_grade11_pct educ_grade12_no_diploma_pct
any white_collar_pct = occ_*_pct
all no_vehicle_b25044_pct = owner_occupied_no_vehicle_pct renter_occupied_no_vehicle_pct
any crowded_b25014_pct = overcrowded_owner_1_to_1_5_per_room_pct overcrowded_owner_1_5_to_2_per_room_pct overcrowded_owner_2plus_per_room_pct
"""

# --- Fixed values: which variables each deprivation index uses --------------------------------
INDEX_VARIABLES = """
SVI: lep_total_pct single_parent_pct crowded_housing_pct multi_unit_housing_pct
SVI: housing_cost_burdened_pct minority_pct pct_below_150pct_poverty unemployment_pct
SVI: cost_burdened_rent_30_34_pct cost_burdened_rent_35_39_pct cost_burdened_rent_40_49_pct
SVI: cost_burdened_rent_50plus_pct no_hs_diploma_pct uninsured_pct age_65plus_pct age_lte17_pct
SVI: disability_pct single_parent_male_hh_pct single_parent_female_hh_pct
SVI: lep_spanish_native_not_well_pct lep_spanish_native_not_at_all_pct
SVI: lep_spanish_foreign_not_well_pct lep_spanish_foreign_not_at_all_pct
SVI: lep_indo_euro_native_not_well_pct lep_indo_euro_native_not_at_all_pct
SVI: lep_indo_euro_foreign_not_well_pct lep_indo_euro_foreign_not_at_all_pct
SVI: lep_asian_pac_native_not_well_pct lep_asian_pac_native_not_at_all_pct
SVI: lep_asian_pac_foreign_not_well_pct lep_asian_pac_foreign_not_at_all_pct
SVI: lep_other_native_not_well_pct lep_other_native_not_at_all_pct
SVI: lep_other_foreign_not_well_pct lep_other_foreign_not_at_all_pct nh_white_pct
SVI: structures_10_19_units_pct structures_20plus_units_pct mobile_homes_pct
SVI: overcrowded_owner_pct overcrowded_renter_pct no_vehicle_pct group_quarters_pct
SDI: single_parent_pct crowded_housing_pct educ_lt12th_grade_pct single_parent_male_hh_pct
SDI: single_parent_female_hh_pct overcrowded_owner_pct overcrowded_renter_pct no_vehicle_pct
SDI: pct_below_100pct_poverty educ_no_schooling_pct educ_nursery_pct educ_kindergarten_pct
SDI: educ_grade1_pct educ_grade2_pct educ_grade3_pct educ_grade4_pct educ_grade5_pct
SDI: educ_grade6_pct educ_grade7_pct educ_grade8_pct educ_grade9_pct educ_grade10_pct
SDI: educ_grade11_pct educ_grade12_no_diploma_pct renter_occupied_pct not_in_labor_force_pct
ADI: pov_total_pct educ_lt9th_grade_pct educ_hs_or_higher_pct white_collar_pct
ADI: no_vehicle_b25044_pct crowded_b25014_pct income_disparity_ratio
ADI: median_owner_cost_mortgage pct_no_telephone unemployment_pct no_vehicle_pct
ADI: educ_no_schooling_pct educ_nursery_pct educ_kindergarten_pct educ_grade1_pct educ_grade2_pct
ADI: educ_grade3_pct educ_grade4_pct educ_grade5_pct educ_grade6_pct educ_grade7_pct
ADI: pov_below_related_children_pct pov_below_other_pct educ_hs_diploma_pct educ_ged_pct
ADI: educ_some_college_lt1yr_pct educ_some_college_ge1yr_pct educ_associates_pct
ADI: educ_bachelors_pct educ_masters_pct educ_professional_degree_pct educ_doctorate_pct
ADI: median_family_income per_capita_income hh_income_lt10k_pct hh_income_ge200k_pct
ADI: occ_male_mgmt_business_science_arts_pct occ_male_business_financial_pct
ADI: occ_male_computer_engineering_science_pct occ_male_education_legal_arts_pct
ADI: occ_male_healthcare_practitioners_pct occ_male_service_pct occ_male_sales_office_pct
ADI: occ_female_mgmt_business_science_arts_pct occ_female_business_financial_pct
ADI: occ_female_computer_engineering_science_pct occ_female_education_legal_arts_pct
ADI: occ_female_healthcare_practitioners_pct occ_female_service_pct occ_female_sales_office_pct
ADI: median_home_value median_gross_rent overcrowded_owner_1_to_1_5_per_room_pct
ADI: overcrowded_owner_1_5_to_2_per_room_pct overcrowded_owner_2plus_per_room_pct
ADI: owner_occupied_no_vehicle_pct renter_occupied_no_vehicle_pct incomplete_plumbing_pct
ADI: owner_occupied_pct heating_fuel_utility_gas_pct
"""

# --- Fixed values: columns of the index file renamed when joined to the survey ----------------
INDEX_EXTRAS = {"MEDMORT": "median_owner_cost_mortgage", "NOINT": "pct_no_telephone"}

# --- Fixed values: state FIPS code, postal abbreviation, census division ----------------------
STATES = """
01 AL East South Central
02 AK Pacific
04 AZ Mountain
05 AR West South Central
06 CA Pacific
08 CO Mountain
09 CT New England
10 DE South Atlantic
11 DC South Atlantic
12 FL South Atlantic
13 GA South Atlantic
15 HI Pacific
16 ID Mountain
17 IL East North Central
18 IN East North Central
19 IA West North Central
20 KS West North Central
21 KY East South Central
22 LA West South Central
23 ME New England
24 MD South Atlantic
25 MA New England
26 MI East North Central
27 MN West North Central
28 MS East South Central
29 MO West North Central
30 MT Mountain
31 NE West North Central
32 NV Mountain
33 NH New England
34 NJ Middle Atlantic
35 NM Mountain
36 NY Middle Atlantic
37 NC South Atlantic
38 ND West North Central
39 OH East North Central
40 OK West South Central
41 OR Pacific
42 PA Middle Atlantic
44 RI New England
45 SC South Atlantic
46 SD West North Central
47 TN East South Central
48 TX West South Central
49 UT Mountain
50 VT New England
51 VA South Atlantic
53 WA Pacific
54 WV South Atlantic
55 WI East North Central
56 WY Mountain
"""

# --- Fixed values: territories, which have a division but no abbreviation ---------------------
TERRITORIES = "60 66 69 72 78"

# --- Fixed values: bounding boxes (west, south, east, north) ----------------------------------
STATE_BOXES = {
    "RI": (-71.908, 41.146, -71.075, 42.018),
    "CT": (-73.728, 40.980, -71.787, 42.050),
    "DE": (-75.789, 38.451, -74.984, 39.839),
    "MA": (-73.508, 41.237, -69.928, 42.887),
}

# --- Fixed values: band sets of the annual and of the seasonal composite ----------------------
ANNUAL_BANDS = (
    "blue green red nir rededge1 rededge2 rededge3 nir08 swir16 swir22 coastal nir09".split()
)
SEASONAL_BANDS = "blue green red nir08 swir16 swir22".split()

# --- Fixed values: mean and standard deviation per seasonal band ------------------------------
BAND_STATS = {
    "blue": (1087.0, 2248.0),
    "green": (1342.0, 2179.0),
    "red": (1433.0, 2178.0),
    "nir08": (2734.0, 1850.0),
    "swir16": (1958.0, 1242.0),
    "swir22": (1363.0, 1049.0),
}

# --- Fixed values: first and last month of each season ----------------------------------------
SEASON_MONTHS = {"spring": (3, 5), "summer": (6, 8), "fall": (9, 11)}

# --- Fixed values: scene classes that hide the ground (snow optional) -------------------------
CLOUDY_CLASSES = (0, 1, 3, 8, 9, 10)
SNOW_CLASS = 11

# --- Fixed values: overview levels, area statistics, chip and patch sizes ---------------------
OVERVIEW_LEVELS = (2, 4, 8, 16, 32)
AREA_STATS = ("MEAN", "MEDIAN", "MINIMUM", "MAXIMUM", "STD")
ANNUAL_CHIP, ANNUAL_PATCH = 128, 8
SEASONAL_CHIP, SEASONAL_PATCH = 224, 16


def lines(text: str) -> list[str]:
    return [line for line in text.strip().splitlines() if line]


def survey_names() -> dict[str, str]:
    """Survey code to column name, all endpoints."""
    text = DETAIL_NAMES + PROFILE_NAMES + SUBJECT_NAMES
    return dict(line.split() for line in lines(text))


def endpoint_variables() -> list[tuple[str, str, int]]:
    """(endpoint, code, position) of every survey variable."""
    endpoints = [
        ("acs/acs5", DETAIL_NAMES), ("acs/acs5/profile", PROFILE_NAMES),
        ("acs/acs5/subject", SUBJECT_NAMES),
    ]
    return [
        (endpoint, line.split()[0], i)
        for endpoint, text in endpoints
        for i, line in enumerate(lines(text))
    ]


def share_specs() -> list[tuple[str, str, str]]:
    """(count, universe, name of the percentage)."""
    specs = []
    for line in lines(UNIVERSES):
        universe, counts = line.split(": ")
        for item in counts.split():
            count, _, name = item.partition("=")
            specs.append((count, universe, name or f"{count}_pct"))
    return specs


def state_table(spark: SparkSession) -> DataFrame:
    """state_fips, abbr (null for territories), division."""
    rows = [(*line.split(" ", 2),) for line in lines(STATES)]
    rows += [(code, None, "Territories") for code in TERRITORIES.split()]
    return spark.createDataFrame(rows, "state_fips string, abbr string, division string")


def membership_table(spark: SparkSession) -> DataFrame:
    """Long (variable, index)."""
    rows = []
    for line in lines(INDEX_VARIABLES):
        index, variables = line.split(": ")
        rows += [(variable, index) for variable in variables.split()]
    return spark.createDataFrame(rows, "variable string, `index` string")


def embedding_columns(dims: int = 64) -> list[str]:
    """A00_MEAN … A63_STD: one column per dimension and area statistic."""
    return [f"A{i:02d}_{stat}" for i in range(dims) for stat in AREA_STATS]
