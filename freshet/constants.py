"""Fixed values of the flood-risk domain: vocabularies, bounds, defaults, actions.

Everything in this module is plain data that results depend on.
"""

# Column roles of an observation row.
TARGET = "flood_risk_score"
CATEGORICAL = [
    "district", "landcover", "soil_type", "water_supply", "electricity",
    "road_quality", "urban_rural", "water_presence_flag",
    "flood_occurrence_current_event", "is_good_to_live",
    "reason_not_good_to_live", "place_name",
]
NOT_FEATURES = ["record_id", "gen_date", "generation_date", "is_synthetic", TARGET]
NUMERIC_INPUTS = [
    "rainfall_7d_mm", "monthly_rainfall_mm", "elevation_m", "distance_to_river_m",
    "drainage_index", "infrastructure_score", "nearest_hospital_km", "nearest_evac_km",
    "built_up_percent", "population_density_per_km2", "ndvi", "ndwi",
    "extreme_weather_index", "seasonal_index", "terrain_roughness_index",
    "socioeconomic_status_index", "historical_flood_count", "inundation_area_sqm",
]
PRECOMPUTED = [
    "distance_to_river_m_log1p", "population_density_per_km2_log1p", "rainfall_7d_mm_log1p",
    "monthly_rainfall_mm_log1p", "nearest_hospital_km_log1p", "nearest_evac_km_log1p",
    "elevation_m_yeojohnson", "drainage_index_yeojohnson",
    "ndvi_qmap", "ndwi_qmap", "built_up_percent_qmap",
]

# Target encodings (column, smoothing) and their products with features.
TARGET_ENCODINGS = [
    ("place_name", 5.0), ("district", 10.0), ("soil_type", 10.0), ("landcover", 10.0),
    ("road_quality", 10.0), ("flood_occurrence_current_event", 10.0),
]
ENCODING_PRODUCTS = [
    # (feature, encoded column, name of the product)
    ("rainfall_7d_mm", "district", "dist_te_x_rain"),
    ("extreme_weather_index", "district", "dist_te_x_extreme"),
    ("historical_flood_count", "district", "dist_te_x_flood"),
    ("rainfall_7d_mm", "flood_occurrence_current_event", "fl_te_x_rain"),
    ("extreme_weather_index", "flood_occurrence_current_event", "fl_te_x_extreme"),
    ("drainage_index", "district", "dist_te_x_drainage"),
    ("river_clip", "district", "dist_te_x_river"),
    ("elevation_m", "district", "dist_te_x_elev"),
    ("historical_flood_count", "flood_occurrence_current_event", "fl_te_x_flood"),
    ("drainage_index", "flood_occurrence_current_event", "fl_te_x_drainage"),
    ("rainfall_7d_mm", "soil_type", "soil_te_x_rain"),
    ("extreme_weather_index", "soil_type", "soil_te_x_extreme"),
]

# The 25 districts, in listing order.
DISTRICTS = [
    "Colombo", "Gampaha", "Kalutara", "Kandy", "Matale", "Nuwara Eliya",
    "Galle", "Matara", "Hambantota", "Jaffna", "Kilinochchi", "Mannar",
    "Mullaitivu", "Vavuniya", "Batticaloa", "Ampara", "Trincomalee",
    "Kurunegala", "Puttalam", "Anuradhapura", "Polonnaruwa", "Badulla",
    "Monaragala", "Ratnapura", "Kegalle",
]

# Typical measures per district, columns as in NUMERIC_INPUTS.
GENERIC_DEFAULTS = (50.0, 200.0, 30.0, 500.0, 0.45, 0.50, 6.0, 4.0, 30.0, 500.0,
                    0.30, 0.10, 0.30, 0.50, 0.20, 0.50, 2, 1000.0)
DISTRICT_DEFAULTS = {
    "Colombo": (65.0, 250.0, 7.0, 320.0, 0.38, 0.72, 2.5, 1.8, 68.0, 3400.0,
                0.18, 0.15, 0.35, 0.55, 0.12, 0.68, 5, 2500.0),
    "Gampaha": (55.0, 220.0, 12.0, 450.0, 0.42, 0.65, 3.5, 2.5, 52.0, 1700.0,
                0.25, 0.12, 0.30, 0.50, 0.15, 0.62, 4, 2000.0),
    "Kalutara": (70.0, 280.0, 15.0, 380.0, 0.40, 0.55, 4.0, 3.0, 40.0, 800.0,
                 0.32, 0.14, 0.38, 0.52, 0.18, 0.55, 4, 1800.0),
    "Ratnapura": (85.0, 350.0, 45.0, 280.0, 0.35, 0.42, 8.0, 6.0, 22.0, 450.0,
                  0.45, 0.18, 0.45, 0.58, 0.35, 0.42, 7, 3500.0),
    "Kandy": (60.0, 230.0, 500.0, 600.0, 0.48, 0.58, 4.5, 3.5, 35.0, 700.0,
              0.38, 0.08, 0.28, 0.48, 0.42, 0.55, 3, 1200.0),
    "Galle": (72.0, 270.0, 10.0, 350.0, 0.42, 0.52, 5.0, 3.5, 38.0, 650.0,
              0.35, 0.16, 0.36, 0.54, 0.20, 0.50, 4, 2200.0),
    "Matara": (68.0, 260.0, 8.0, 400.0, 0.44, 0.50, 5.5, 4.0, 32.0, 550.0,
               0.33, 0.13, 0.33, 0.52, 0.22, 0.48, 3, 1600.0),
    "Batticaloa": (75.0, 290.0, 5.0, 250.0, 0.32, 0.38, 7.0, 5.5, 25.0, 380.0,
                   0.28, 0.22, 0.42, 0.60, 0.10, 0.38, 6, 3000.0),
    "Kurunegala": (50.0, 200.0, 120.0, 700.0, 0.50, 0.52, 6.0, 4.5, 28.0, 520.0,
                   0.40, 0.08, 0.25, 0.45, 0.25, 0.50, 2, 800.0),
    "Anuradhapura": (45.0, 180.0, 90.0, 900.0, 0.55, 0.45, 10.0, 7.0, 18.0, 280.0,
                     0.42, 0.06, 0.22, 0.42, 0.15, 0.42, 2, 600.0),
}

# Categorical defaults of a scenario row.
SCENARIO_TEXT_DEFAULTS = {
    "landcover": "Urban", "soil_type": "Clay", "water_supply": "Pipe-borne",
    "electricity": "Yes", "road_quality": "Moderate", "urban_rural": "Urban",
    "water_presence_flag": "No", "flood_occurrence_current_event": "No",
    "is_good_to_live": "Yes", "reason_not_good_to_live": "Other",
    "place_name": "Unknown", "generation_date": "2024-06-15",
}

# Numeric defaults of a simulation request, where a field is absent.
REQUEST_NUMERIC_DEFAULTS = {
    "rainfall_7d_mm": 50.0, "monthly_rainfall_mm": 200.0, "extreme_weather_index": 0.3,
    "seasonal_index": 0.5, "elevation_m": 30.0, "distance_to_river_m": 500.0,
    "drainage_index": 0.5, "terrain_roughness_index": 0.3, "infrastructure_score": 0.5,
    "nearest_hospital_km": 5.0, "nearest_evac_km": 3.0, "socioeconomic_status_index": 0.5,
    "population_density_per_km2": 500.0, "ndvi": 0.3, "ndwi": 0.1, "built_up_percent": 30.0,
    "historical_flood_count": 2, "inundation_area_sqm": 1000.0, "is_synthetic": 0,
}

# Accepted ranges (column, lowest, highest; None = open end).
NUMERIC_BOUNDS = [
    ("rainfall_7d_mm", 0, 1500), ("monthly_rainfall_mm", 0, 3000),
    ("extreme_weather_index", 0, 1), ("seasonal_index", 0, 1),
    ("elevation_m", -10, 2500), ("distance_to_river_m", 0, 50000),
    ("drainage_index", 0, 1), ("terrain_roughness_index", 0, 1),
    ("infrastructure_score", 0, 1), ("nearest_hospital_km", 0, 100),
    ("nearest_evac_km", 0, 100), ("socioeconomic_status_index", 0, 1),
    ("population_density_per_km2", 0, 50000), ("ndvi", -1, 1), ("ndwi", -1, 1),
    ("built_up_percent", 0, 100), ("historical_flood_count", 0, 100),
    ("inundation_area_sqm", 0, None), ("is_synthetic", 0, 1),
]

# Accepted vocabularies.
MODEL_VERSIONS = ["v13", "v18_titan", "v20_colossus"]
VOCABULARIES = {
    "model_version": MODEL_VERSIONS,
    "district": DISTRICTS,
    "landcover": ["Urban", "Agricultural", "Forest", "Water Body", "Wetland", "Barren", "Grassland"],
    "soil_type": ["Clay", "Sandy", "Loam", "Silt", "Laterite", "Alluvial", "Red-Yellow Podzolic"],
    "water_supply": ["Pipe-borne", "Well", "River", "Tank", "Borehole", "Spring"],
    "road_quality": ["Good", "Moderate", "Poor", "Very Poor"],
    "urban_rural": ["Urban", "Rural", "Semi-Urban"],
    "flood_occurrence_current_event": ["Yes", "No"],
    "is_good_to_live": ["Yes", "No"],
}

# Factor applied to the heuristic score per model version (others: 1).
VERSION_FACTORS = {"v18_titan": 0.98, "v20_colossus": 0.97}

# Risk levels, lower bound included, upper bound excluded.
LEVELS = ["Low", "Medium", "High", "Critical"]
LEVEL_THRESHOLDS = {"Low": 0.25, "Medium": 0.50, "High": 0.75, "Critical": 1.00}

# Sweep grid (feature, label, category, low, high, improved value or None).
SWEEP_STEPS = 10
SWEEP_FEATURES = [
    ("drainage_index", "Drainage System", "Infrastructure", 0.0, 1.0, 0.85),
    ("infrastructure_score", "Infrastructure Score", "Infrastructure", 0.0, 1.0, 0.90),
    ("nearest_hospital_km", "Hospital Distance", "Healthcare", 0.0, 50.0, 1.5),
    ("nearest_evac_km", "Evacuation Center", "Emergency", 0.0, 50.0, 1.0),
    ("built_up_percent", "Built-Up Area %", "Land Use", 0.0, 100.0, None),
    ("distance_to_river_m", "River Setback", "Geography", 0.0, 5000.0, 1500.0),
    ("elevation_m", "Elevation", "Geography", 0.0, 500.0, None),
]

# Planner actions (feature, label, category, target, higher is better,
# cost level, cost weight, preferred by the low-cost profile, rationale).
ACTIONS = [
    ("drainage_index", "Drainage System", "Infrastructure", 0.85, True, "low", 1.0, True,
     "Improve drainage capacity to move stormwater away from exposed areas."),
    ("infrastructure_score", "Infrastructure Score", "Infrastructure", 0.90, True, "low", 1.1, True,
     "Strengthen protective infrastructure and improve service resilience."),
    ("nearest_evac_km", "Evacuation Center Distance", "Emergency", 1.0, False, "medium", 2.0, False,
     "Reduce access distance by adding or relocating evacuation capacity."),
    ("nearest_hospital_km", "Hospital Distance", "Healthcare", 1.5, False, "high", 3.0, False,
     "Improve emergency healthcare access for flood-affected communities."),
    ("distance_to_river_m", "River Setback", "Geography", 1500.0, True, "high", 3.2, False,
     "Increase effective river setback through zoning or protective relocation."),
    ("built_up_percent", "Built-Up Area", "Land Use", 10.0, False, "low", 1.2, True,
     "Reduce impermeable coverage and create more space for water absorption."),
]
PROFILE_FRACTIONS = {
    "low_cost": [0.25, 0.50],
    "balanced": [0.33, 0.66, 1.00],
    "aggressive": [0.50, 0.75, 1.00],
}
STALL_TEXT = ("No further supported candidate reduced the predicted risk; "
              "review constraints or allowed features.")

# Direction rules and labels of a scenario comparison.
GOOD_WHEN_RISING = ["drainage_index", "infrastructure_score", "distance_to_river_m", "elevation_m"]
GOOD_WHEN_FALLING = ["nearest_hospital_km", "nearest_evac_km", "rainfall_7d_mm", "extreme_weather_index"]
FEATURE_LABELS = {
    "rainfall_7d_mm": "7-Day Rainfall", "monthly_rainfall_mm": "Monthly Rainfall",
    "drainage_index": "Drainage Index", "infrastructure_score": "Infrastructure Score",
    "nearest_hospital_km": "Hospital Distance", "nearest_evac_km": "Evacuation Distance",
    "built_up_percent": "Built-Up %", "distance_to_river_m": "River Distance",
    "elevation_m": "Elevation", "extreme_weather_index": "Extreme Weather",
    "seasonal_index": "Seasonal Index", "terrain_roughness_index": "Terrain Roughness",
    "historical_flood_count": "Historical Floods",
    "population_density_per_km2": "Population Density", "ndvi": "NDVI", "ndwi": "NDWI",
    "socioeconomic_status_index": "Socioeconomic Index", "inundation_area_sqm": "Inundation Area",
}

# The log columns whose use is counted, and the score bins.
TRACKED_COLUMNS = [
    "rainfall_7d_mm", "drainage_index", "infrastructure_score", "nearest_hospital_km",
    "elevation_m", "distance_to_river_m", "built_up_percent", "nearest_evac_km",
]
SCORE_BINS = [("0.0-0.25", None, 0.25), ("0.25-0.50", 0.25, 0.50),
              ("0.50-0.75", 0.50, 0.75), ("0.75-1.0", 0.75, None)]

# The features of a serving model, in the order of its input.
FEATURES_108 = [
    "district", "place_name", "latitude", "longitude", "elevation_m", "distance_to_river_m", "landcover",
    "soil_type", "water_supply", "electricity", "road_quality", "population_density_per_km2",
    "built_up_percent", "urban_rural", "rainfall_7d_mm", "monthly_rainfall_mm", "drainage_index", "ndvi",
    "ndwi", "water_presence_flag", "historical_flood_count", "infrastructure_score", "nearest_hospital_km",
    "nearest_evac_km", "flood_occurrence_current_event", "inundation_area_sqm", "is_good_to_live",
    "reason_not_good_to_live", "distance_to_river_m_log1p", "population_density_per_km2_log1p",
    "rainfall_7d_mm_log1p", "monthly_rainfall_mm_log1p", "nearest_hospital_km_log1p", "nearest_evac_km_log1p",
    "elevation_m_yeojohnson", "drainage_index_yeojohnson", "ndvi_qmap", "ndwi_qmap", "built_up_percent_qmap",
    "seasonal_index", "terrain_roughness_index", "socioeconomic_status_index", "extreme_weather_index",
    "gen_month", "gen_year", "gen_day_of_year", "gen_quarter", "is_ne_monsoon", "is_sw_monsoon",
    "gen_month_sin", "gen_month_cos", "reason_flood_flag", "reason_infra_flag", "reason_road_flag",
    "reason_other_flag", "is_good_binary", "log_inundation", "sqrt_inundation", "inundation_per_pop",
    "record_id_num", "rainfall_x_flood", "monthly_x_flood", "rain_ratio", "rain_cum", "river_clip",
    "river_rain_risk", "river_monthly_risk", "elev_clip", "elev_rain_ratio", "low_elev_flag", "infra_socio",
    "water_veg_balance", "ndvi_ndwi_product", "ndwi_sq", "drainage_x_rain", "bad_drainage_rain", "urban_runoff",
    "evac_hosp_sum", "max_dist_help", "pop_x_rain", "pop_x_flood", "extreme_x_rain", "extreme_x_flood",
    "extreme_x_monthly", "seasonal_rain", "seasonal_extreme", "terrain_rain", "inundation_x_rain",
    "log_inundation_x_extreme", "composite_vuln", "place_name_te", "district_te", "soil_type_te",
    "landcover_te", "road_quality_te", "flood_occurrence_current_event_te", "dist_te_x_rain",
    "dist_te_x_extreme", "dist_te_x_flood", "fl_te_x_rain", "fl_te_x_extreme", "dist_te_x_drainage",
    "dist_te_x_river", "dist_te_x_elev", "fl_te_x_flood", "fl_te_x_drainage", "soil_te_x_rain",
    "soil_te_x_extreme",
]

# The same with products of transformed columns.
FEATURES_115 = [
    "district", "place_name", "latitude", "longitude", "elevation_m", "distance_to_river_m", "landcover",
    "soil_type", "water_supply", "electricity", "road_quality", "population_density_per_km2",
    "built_up_percent", "urban_rural", "rainfall_7d_mm", "monthly_rainfall_mm", "drainage_index", "ndvi",
    "ndwi", "water_presence_flag", "historical_flood_count", "infrastructure_score", "nearest_hospital_km",
    "nearest_evac_km", "flood_occurrence_current_event", "inundation_area_sqm", "is_good_to_live",
    "reason_not_good_to_live", "distance_to_river_m_log1p", "population_density_per_km2_log1p",
    "rainfall_7d_mm_log1p", "monthly_rainfall_mm_log1p", "nearest_hospital_km_log1p", "nearest_evac_km_log1p",
    "elevation_m_yeojohnson", "drainage_index_yeojohnson", "ndvi_qmap", "ndwi_qmap", "built_up_percent_qmap",
    "seasonal_index", "terrain_roughness_index", "socioeconomic_status_index", "extreme_weather_index",
    "gen_month", "gen_year", "gen_day_of_year", "gen_quarter", "is_ne_monsoon", "is_sw_monsoon",
    "gen_month_sin", "gen_month_cos", "reason_flood_flag", "reason_infra_flag", "reason_road_flag",
    "reason_other_flag", "is_good_binary", "log_inundation", "sqrt_inundation", "inundation_per_pop",
    "record_id_num", "rainfall_x_flood", "monthly_x_flood", "rain_ratio", "rain_cum", "river_clip",
    "river_rain_risk", "river_monthly_risk", "elev_clip", "elev_rain_ratio", "low_elev_flag", "infra_socio",
    "water_veg_balance", "ndvi_ndwi_product", "ndwi_sq", "drainage_x_rain", "bad_drainage_rain", "urban_runoff",
    "evac_hosp_sum", "max_dist_help", "pop_x_rain", "pop_x_flood", "extreme_x_rain", "extreme_x_flood",
    "extreme_x_monthly", "seasonal_rain", "seasonal_extreme", "terrain_rain", "inundation_x_rain",
    "log_rain_x_flood", "log_rain_x_extreme", "log_river_x_rain", "log_river_x_extreme", "log_pop_x_rain",
    "ndwi_qmap_x_rain", "yj_elev_x_rain", "log_inundation_x_extreme", "composite_vuln", "place_name_te",
    "district_te", "soil_type_te", "landcover_te", "road_quality_te", "flood_occurrence_current_event_te",
    "dist_te_x_rain", "dist_te_x_extreme", "dist_te_x_flood", "fl_te_x_rain", "fl_te_x_extreme",
    "dist_te_x_drainage", "dist_te_x_river", "dist_te_x_elev", "fl_te_x_flood", "fl_te_x_drainage",
    "soil_te_x_rain", "soil_te_x_extreme",
]
