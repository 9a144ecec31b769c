"""Fixed values the results depend on. They are data, stated once, in natural order."""

# --- species and alert thresholds, cells per litre (fixed values) ---
SPECIES_THRESHOLDS = {
    "Alexandrium_catenella": {"warning": 100, "closure": 300},
    "Dinophysis_acuminata": {"warning": 200, "closure": 500},
    "Dinophysis_norvegica": {"warning": 200, "closure": 500},
    "Karenia": {"warning": 1_000, "closure": 5_000},
    "Pseudo-nitzschia": {"warning": 2_000, "closure": 13_000},
}
SPECIES = list(SPECIES_THRESHOLDS)
TIERS = ["warning", "closure"]
CONCENTRATION_COLUMNS = [
    "Alexandrium_catenella",
    "Dinophysis_acuminata",
    "Dinophysis_norvegica",
    "Karenia",
    "Margalefidinium",
    "Mesodinium",
    "Pseudo-nitzschia",
    "Tripos_furca",
    "Tripos_fusus",
    "Tripos_muelleri",
]

# --- stations (fixed values) ---
STATION_COORDINATES = {
    "harpswell": (43.781, -69.975),
    "fiddlers": (41.645, -70.675),
    "gsodock": (41.570, -71.410),
    "mvco": (41.325, -70.566),
    "mdibl": (44.440, -68.205),
}
EXCLUDED_STATIONS = ["nauset", "jamestown", "lombos"]
EXCLUDED_LOCATIONS = ["drqnp"]
TEST_DATASETS = [
    "mvco",
    "gsodock",
    "harpswell",
    "fiddlers",
    "mdibl",
    "ecoa",
    "oceanalliance",
    "radbot_mvco",
    "radbot_ios",
    "radbot_jeffreys_basin",
]
SPATIAL_DATASETS = TEST_DATASETS + ["NESLTER_broadscale", "azmp", "gom"]

# --- polygons as (longitude, latitude) rings; three different ones exist (fixed values) ---
POLYGON_MATCHUP = [(-70.0, 38.0), (-60.0, 42.0), (-64.0, 45.0), (-73.0, 43.0)]
POLYGON_ACQUISITION = [(-70.0, 38.0), (-62.0, 42.0), (-64.0, 46.0), (-73.0, 43.0)]
POLYGON_CLOUD = [(-70.0, 38.0), (-61.0, 41.0), (-64.0, 46.0), (-73.0, 43.0)]

# --- bands, wavelengths in nm, derived products (fixed values) ---
GRID_BANDS = ["rrs_2", "rrs_4", "rrs_6", "rrs_8", "rrs_9", "rrs_10", "rrs_11", "rrs_12", "rrs_17"]
SWATH_BANDS = [
    "rrs_412",
    "rrs_443",
    "rrs_490",
    "rrs_510",
    "rrs_560",
    "rrs_620",
    "rrs_665",
    "rrs_674",
    "rrs_682",
    "rrs_709",
    "rrs_754",
    "rrs_865",
]
BAND_TO_WAVELENGTH = {
    "rrs_2": "rrs_412",
    "rrs_4": "rrs_490",
    "rrs_6": "rrs_560",
    "rrs_8": "rrs_665",
    "rrs_9": "rrs_673",
    "rrs_10": "rrs_682",
    "rrs_11": "rrs_709",
    "rrs_12": "rrs_754",
    "rrs_17": "rrs_865",
}
IOP_COLUMNS = ["kd489", "kdmin", "iop_adet", "iop_agelb", "iop_apig", "iop_bpart", "iop_bwit"]
DERIVED_PRODUCTS = ["CHL_OC4ME", "CHL_NN", "TSM_NN", "ADG443_NN", "KD490_M07"]
INDEX_NAMES = [
    "FLH_681",
    "FLH_665",
    "FLHmax",
    "GLH",
    "BLH",
    "MCI",
    "RBD",
    "DINI",
    "EBI",
    "GBI",
    "KBBI",
    "NDNI",
    "NDCI",
    "NDWI",
    "RedEdge_Ratio",
    "CI",
    "BlueGreen_Ratio",
    "Green_Red_Ratio",
    "Blue_Red_Ratio",
    "Red_NIR_Ratio",
    "Fluorescence_Peak",
]
INDEX_EPSILON = 1e-10

# --- pixel flag bits (fixed values) ---
WATER_BIT = 2
VALID_PE_BIT = 1 << 31
CLOUD_BIT = 1 << 10
CLOUD_AMBIGUOUS_BIT = 1 << 11
INVALID_BIT = 1 << 19

# --- ocean model (fixed values) ---
OCEAN_VARIABLES = ["temp_sur", "salt_sur", "zeta", "u_sur", "v_sur", "Uwind", "Vwind", "Pair"]
MODEL_FEATURES = [
    "roms_temp_sur",
    "roms_salt_sur",
    "roms_zeta",
    "roms_u_sur",
    "roms_v_sur",
    "roms_Uwind",
    "roms_Vwind",
    "roms_Pair",
    "roms_current_speed",
    "roms_current_dir",
    "roms_wind_speed",
    "roms_wind_dir",
]
MODEL_BBOX = {"west": -72.0, "south": 38.0, "east": -60.0, "north": 48.0}
LAGS = [-2, -1, 0, 1, 2]

# --- tracks: three satellite sources, each with and without the model features (fixed values) ---
SOURCE_PREFIXES = {"C2RCC": "C", "ACOLITE": "A", "Baseline": "B"}
SEASON_FEATURES = ["doy_sin", "doy_cos"]

# --- matchup and evaluation parameters (fixed values) ---
WINDOW_DAYS = 3
HALF_BOX_DEG = 0.02
MIN_VALID_PIXELS = 3
SWATH_RESOLUTION_DEG = 0.003
SWATH_RADIUS_M = 400.0
MAX_GRID_DIST_DEG = 0.02
MORAN_RADII_M = [2_000, 5_000, 10_000, 20_000, 35_000, 50_000]
