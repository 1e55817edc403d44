"""Fixed values that decide results."""

# --- fixed values: calendar and sources ---
EPOCH = "2000-01-01"
SOURCES = ("s1", "s2", "s3")                 # priority order
SOURCE_OFFSET = (0.0, 0.037, 0.083)          # offset of each source from the first
CYCLE_PERIOD = (5, 8)                        # revisit period of the first two sources, days
GRID_DOY = tuple(range(1, 366, 16))          # fixed calendar grid of the third source
SEASON_DOY = (91, 304)
MAIN_SEASON_END = 243
SEASON_ROWS = 213                            # rows of a complete daily season
FULL_GRID_ROWS = 200

# --- fixed values: status and phases ---
Z_DEPRESSED, Z_CRITICAL = -1.0, -2.0
PHASES = (("spring", 91, 135), ("peak", 136, 175), ("ripening", 176, 220),
          ("after_harvest", 221, 260), ("autumn", 261, 304))

# --- fixed values: harmonisation and curves ---
NORM_WINDOW = 8
STD_FLOOR = 0.04
CURVE_BW = 8.0
KERNEL_CUTOFF = 3.0
ARTIFACT_ABS, ARTIFACT_MAD_K = 0.15, 3.0
CONFIRM_DAYS, CONFIRM_DIFF = 11, 0.10
MIN_CURVE_WEIGHT = 0.8
EDGE_DAYS = 2
OFFSET_SHRINK = 10
CURVE_RANGE = (-0.1, 1.0)
CURVE_MIN_POINTS = 5
CATEGORY_MIN_ENTITIES = 3

# --- fixed values: episodes ---
EPISODE_MIN_DAYS, EPISODE_MIN_OBS, EPISODE_MERGE_GAP = 7, 2, 5
SUSTAINED_DAYS, SUSTAINED_MEAN_Z = 14, -1.2
STRONG_Z = -1.5
PROLONGED_DAYS, PROLONGED_MEAN_Z = 30, -0.9
CRITICAL_MIN_DAYS = 5

# --- fixed values: drivers and causes ---
BEFORE_DAYS = 30
DEFICIT_PCT, WARM_ANOMALY, HOT_DAY, DRY_DAY = 40.0, 1.0, 27.0, 1.0
MIN_DRIVER_DAYS, LONG_DRY_SPELL = 20, 20
FLAT_PEAK, LOW_PEAK_RATIO, EARLY_DECLINE_DAYS = 0.35, 0.7, 15
REGION_LOW_Z, REGION_NORMAL_Z, ROTATION_SHIFT = -0.7, -0.3, 25
REGION_MIN_ENTITIES = 3

# --- fixed values: reconstruction ---
GAP_SHARE = 0.15
N_NEIGHBORS, MAX_NEIGHBOR_DAYS = 3, 60
COMPOSITE_DAYS = 15
BANDWIDTHS = (6.0, 15.0)
SCORE_MAX, SCORE_RMSE = 30.0, 0.10
GDD_PROFILES = {"corn": (10.0, 30.0, True), "sunflower": (20 / 3, None, False), "custom": (None, None, False)}
