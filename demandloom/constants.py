"""Tables that have to equal the published inputs to give equal results."""

# --- fixed values: parameter lists of the study grid ---
BLDG_TYPES = ["SmallOffice", "MediumOffice", "LargeOffice", "SmallRetail", "MediumRetail"]
BLDG_VINTAGES = ["pre1980", "post1980", "2004", "2010", "2016"]
CLIMATES = ["2A", "2B", "3A", "3B", "4A"]
HVAC_TSTAT = [70, 71, 72, 73, 74, 75, 76]
EVENT_START = list(range(6, 22))
EVENT_HOURS = [2, 4, 6]
PRECOOL_HOURS = [2, 4, 6]
PRECOOL_DEG = [0, 2, 4]
RESET_DEG = [0, 2, 4, 6]
LATEST_END = 22
COOLEST_PRECOOL = 70
WARMEST_RESET = 80

# --- fixed values: ordinal codes of the grid columns ---
CODES = {
    "bldg_type": {
        "SmallOffice": 1, "MediumOffice": 2, "LargeOffice": 3, "SmallRetail": 4, "MediumRetail": 5,
    },
    "bldg_vintage": {"pre1980": 1, "post1980": 2, "2004": 3, "2010": 4, "2016": 5},
    "climate": {"2A": 1, "2B": 2, "3A": 3, "3B": 4, "4A": 5},
    "hvac_tstat": {70: 1, 71: 2, 72: 3, 73: 4, 74: 5, 75: 6, 76: 7},
    "event_start": {
        6: 1, 7: 2, 8: 3, 9: 4, 10: 5, 11: 6, 12: 7, 13: 8,
        14: 9, 15: 10, 16: 11, 17: 12, 18: 13, 19: 14, 20: 15, 21: 16,
    },
    "event_hours": {2: 5, 4: 8, 6: 11},
    "precool_hours": {4: 6, 6: 11},
    "precool_deg": {0: 6, 2: 11},
    "reset_deg": {0: 4, 2: 7, 4: 10, 6: 13},
}

# --- fixed values: folder and argument names of the workflow steps ---
STEP_PROTOTYPE = "CreateDOEPrototypeBuilding"
STEP_TIMESTEP = "SetTimestep"
STEP_WALL_R = "IncreaseWallRValue"
STEP_SETPOINT = "ChangeHeatingAndCoolingSetpoint"
STEP_OUTPUT_VARIABLE = "AddOutputVariable"
STEP_OUTPUT_METER = "AddOutputMeter"
OUTDOOR_TEMPERATURE = "Site Outdoor Air Drybulb Temperature"

# --- fixed values: report rows collected for every run ---
OUTPUT_SPEC = {
    "oat_c": ("Environment", OUTDOOR_TEMPERATURE, "Zone Timestep"),
    "elec_j": (None, "Electricity:Facility", "Zone Timestep"),
}

# --- fixed values: accepted choices ---
REPORTING_FREQUENCIES = ["detailed", "timestep", "hourly", "daily", "monthly", "runperiod"]
PROTOTYPE_TYPES = [
    "SecondarySchool", "PrimarySchool", "SmallOffice", "MediumOffice", "LargeOffice",
    "SmallHotel", "LargeHotel", "Warehouse", "RetailStandalone", "RetailStripmall",
    "QuickServiceRestaurant", "FullServiceRestaurant", "MidriseApartment",
    "HighriseApartment", "Hospital", "Outpatient",
]
PROTOTYPE_TEMPLATES = [
    "DOE Ref Pre-1980", "DOE Ref 1980-2004", "90.1-2004", "90.1-2007",
    "90.1-2010", "90.1-2013", "NECB 2011",
]
PROTOTYPE_CLIMATES = [
    "ASHRAE 169-2006-1A", "ASHRAE 169-2006-2A", "ASHRAE 169-2006-2B", "ASHRAE 169-2006-3A",
    "ASHRAE 169-2006-3B", "ASHRAE 169-2006-3C", "ASHRAE 169-2006-4A", "ASHRAE 169-2006-4B",
    "ASHRAE 169-2006-4C", "ASHRAE 169-2006-5A", "ASHRAE 169-2006-5B", "ASHRAE 169-2006-6A",
    "ASHRAE 169-2006-6B", "ASHRAE 169-2006-7A", "ASHRAE 169-2006-8A", "NECB HDD Method",
]

# --- fixed values: schedule type limits (name, lower, upper, numeric type, unit) ---
SCHEDULE_TYPE_LIMITS = [
    ("Lights", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("Occupancy", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("People Activity", 0.0, None, "Continuous", "ActivityLevel"),
    ("Equipment", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("Water Use", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("Elevators", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("Process Load", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("Thermostat Heating Setpoint", 0.0, 100.0, "Continuous", "Temperature"),
    ("Thermostat Cooling Setpoint", 0.0, 100.0, "Continuous", "Temperature"),
    ("HVAC Operation", 0.0, 1.0, "Discrete", "Availability"),
    ("Temperature", None, None, "Continuous", "Temperature"),
    ("Fraction", 0.0, 1.0, "Continuous", "Dimensionless"),
    ("Dimensionless", None, None, "Continuous", "Dimensionless"),
]

# --- fixed values: run messages that carry no information ---
SKIP_MESSAGE_PARTS = ["Skipping layer", "UseWeatherFile"]
SKIP_CHANNEL_PARTS = ["runmanager", "setFileExtension", "Translator"]

# --- fixed values: construction slots of a default construction set ---
SURFACE_SLOTS = ["floor", "wall", "roof_ceiling"]
SUB_SURFACE_SLOTS = [
    "fixed_window", "operable_window", "door", "glass_door", "overhead_door", "skylight",
    "tubular_daylight_dome", "tubular_daylight_diffuser",
]
MISC_SLOTS = ["interior_partition", "space_shading", "building_shading", "site_shading"]

# --- fixed values: solar reflectance index (ASTM E1980, medium wind) ---
SRI_NUMERATOR = (20.797, -0.603)
SRI_DENOMINATOR = (9.5205, 12.0)
SRI_POLYNOMIAL = (123.97, -141.35, 9.6555)

WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
