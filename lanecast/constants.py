"""Fixed values of the quoting model.

Everything in this module is a fixed value that must equal the behaviour being
reproduced (rates, thresholds, labels, the city list).  They are stated plainly,
in natural order, and are not derived from data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: feature pipeline
# ---------------------------------------------------------------------------
FUEL_RATE = 87.67          # rupees per litre used for the historical fuel estimate
HIST_MILEAGE = 3.5         # km per litre used for the historical fuel estimate
LAMBDA_BASE = 0.062        # time-decay rate of the efficiency score
GRACE_PERIOD = 4.0         # hours of dwell that cost nothing
DWELL_FLOOR_HOURS = 48.0   # lower bound of the continuity threshold
PEAK_MONTHS = (10, 11, 12)
EFFICIENCY_LABELS = ("Low", "Medium", "High")

# ---------------------------------------------------------------------------
# FIXED VALUES: quoting service
# ---------------------------------------------------------------------------
DEFAULT_DIESEL = 87.67
AVG_SPEED_KMPH = 50.0
ROAD_FACTOR = 1.32
EPSILON_HIGH = 0.12
EPSILON_LOW = 0.10
T_GRACE = 4.0
BUSINESS_START = 8.0
BUSINESS_END = 20.0
BUSINESS_HOURS = 12.0
DEPARTURE_HOUR = 6
DEFAULT_DISTANCE_KM = 500.0
DEFAULT_VEHICLE = "FTL"

# class -> toll (Rs/km), wage (Rs/day), maint (Rs/day), mob (Rs/trip), lam (p_return decay)
VEHICLE_CONFIG = {
    "LCV":     {"toll": 0.80, "wage": 800.0,  "maint": 150.0, "mob": 1500.0, "lam": 0.15},
    "MCV":     {"toll": 1.60, "wage": 1000.0, "maint": 280.0, "mob": 2500.0, "lam": 0.10},
    "FTL":     {"toll": 2.50, "wage": 1200.0, "maint": 400.0, "mob": 4500.0, "lam": 0.062},
    "CARTING": {"toll": 0.50, "wage": 700.0,  "maint": 100.0, "mob": 800.0,  "lam": 0.15},
}

# Mileage curves per class: (floor, intercept, slope) for km/l = max(floor, intercept - slope * tonnes).
# Classes not listed use the "OTHER" curve (FTL and anything unknown).
LOADED_MILEAGE = {
    "LCV":     (12.0, 20.0, 2.5),
    "MCV":     (6.0, 13.0, 1.0),
    "CARTING": (4.0, 10.0, 0.35),
    "OTHER":   (2.5, 4.5, 0.06),
}
EMPTY_MILEAGE = {
    "LCV":     (15.0, 24.0, 2.0),
    "MCV":     (8.0, 16.0, 1.0),
    "CARTING": (6.0, 13.0, 0.40),
    "OTHER":   (3.0, 5.5, 0.08),
}
# distance adjustments: (+long bonus when km > 500, -short penalty when km < 150, overall floor)
LOADED_ADJUST = (0.5, 0.2, 1.5)
EMPTY_ADJUST = (0.5, 0.3, 2.5)
LONG_HAUL_KM = 500.0
SHORT_HAUL_KM = 150.0

# decision confidence: trips for full data confidence, weights, spread of the model part, distance penalty, range
CONFIDENCE_TRIPS = 50.0
CONFIDENCE_DATA = 0.55
CONFIDENCE_MODEL = 0.35
CONFIDENCE_SPREAD = 0.8
CONFIDENCE_PENALTY = 0.08
CONFIDENCE_RANGE = (0.10, 0.97)
# price corridor: model premium and adjustment, range of the multiplier, width, survival share of wages, margin
DELAY_PREMIUM = 0.10
EFFICIENCY_ADJUST = 0.08
MULTIPLIER_RANGE = (0.95, 1.15)
CORRIDOR_WIDTH = 1.15
SURVIVAL_WAGE_SHARE = 0.80
HEALTHY_MARGIN = 0.10

# add-on id -> (label, fixed cost or None, share of the recommended price or None)
ADDON_CONFIG = {
    "helper_required":  ("Helpers (load + unload)", 1200, None),
    "extra_tarpaulin":  ("Extra Tarpaulin (Tirpal)", 500, None),
    "extra_rope":       ("Extra Rope", 150, None),
    "owner_escort":     ("Owner's Escort (person)", 900, None),
    "express_delivery": ("Express Delivery", None, 0.30),
}

# ---------------------------------------------------------------------------
# FIXED VALUES: models
# ---------------------------------------------------------------------------
# trees, depth, learning rate, row share per tree, column share per node, least rows of a child, least gain (summed
# over the rows), early stopping
RISK_MODEL = (800, 6, 0.04, 0.85, "0.8", 3, 0.1, True)
PRICING_MODEL = (1200, 7, 0.025, 0.85, "0.8", 2, 0.05, True)
# settings of the older program: classifier, regressor
RISK_500 = (500, 6, 0.05)
PRICING_1000 = (1000, 8, 0.03)
EARLY_STOPPING_ROUNDS = 50
V7_GRID = {
    "n_estimators": [500, 1000, 1500], "max_depth": [5, 7, 9], "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.8, 0.9], "colsample_bytree": [0.8, 0.9], "gamma": [0.1, 0.2],
    "reg_alpha": [0.1, 0.5], "reg_lambda": [1.5, 2.0],
}

# UI weight limits per class: (maximum tonnes, default tonnes when the maximum is exceeded)
WEIGHT_LIMITS = {
    "LCV": (3.0, 1.5),
    "MCV": (12.0, 5.0),
    "FTL": (30.0, 10.0),
    "CARTING": (5.0, 1.0),
}

SEASON_MAP = {
    1: "Winter", 2: "Winter", 3: "Pre-Summer",
    4: "Summer", 5: "Summer", 6: "Summer",
    7: "Monsoon", 8: "Monsoon", 9: "Monsoon",
    10: "Peak", 11: "Peak", 12: "Peak",
}

# Fallback lane context when no feature table exists.
NO_KB_GLOBAL = {"lane_popularity": 0.35, "route_risk": 0.30, "driver_delay_rate": 0.20,
                "trip_count": 0, "avg_dist_km": 500.0}

# Indian city gazetteer: name -> (lat, lon); aliases share coordinates.
CITY_COORDS = {
    "delhi": (28.6139, 77.2090), "new delhi": (28.6139, 77.2090),
    "mumbai": (19.0760, 72.8777), "bombay": (19.0760, 72.8777),
    "kolkata": (22.5726, 88.3639), "calcutta": (22.5726, 88.3639),
    "chennai": (13.0827, 80.2707), "madras": (13.0827, 80.2707),
    "bangalore": (12.9716, 77.5946), "bengaluru": (12.9716, 77.5946),
    "hyderabad": (17.3850, 78.4867),
    "pune": (18.5204, 73.8567),
    "ahmedabad": (23.0225, 72.5714),
    "jaipur": (26.9124, 75.7873),
    "lucknow": (26.8467, 80.9462),
    "kanpur": (26.4499, 80.3319),
    "nagpur": (21.1458, 79.0882),
    "indore": (22.7196, 75.8577),
    "bhopal": (23.2599, 77.4126),
    "patna": (25.5941, 85.1376),
    "surat": (21.1702, 72.8311),
    "vadodara": (22.3072, 73.1812),
    "ludhiana": (30.9010, 75.8573),
    "amritsar": (31.6340, 74.8723),
    "chandigarh": (30.7333, 76.7794),
    "kochi": (9.9312, 76.2673),
    "coimbatore": (11.0168, 76.9558),
    "visakhapatnam": (17.6868, 83.2185), "vizag": (17.6868, 83.2185),
    "bhubaneswar": (20.2961, 85.8245),
    "guwahati": (26.1445, 91.7362),
    "roorkee": (29.8543, 77.8880),
    "haridwar": (29.9457, 78.1642),
    "dehradun": (30.3165, 78.0322),
    "meerut": (28.9845, 77.7064),
    "agra": (27.1767, 78.0081),
    "varanasi": (25.3176, 82.9739),
    "prayagraj": (25.4358, 81.8463), "allahabad": (25.4358, 81.8463),
    "jodhpur": (26.2389, 73.0243),
    "udaipur": (24.5854, 73.7125),
    "kota": (25.2138, 75.8648),
    "gwalior": (26.2183, 78.1828),
    "jabalpur": (23.1815, 79.9864),
    "raipur": (21.2514, 81.6296),
    "ranchi": (23.3441, 85.3096),
    "jamshedpur": (22.8046, 86.2029),
    "jammu": (32.7266, 74.8570),
    "goa": (15.2993, 74.1240),
    "panaji": (15.4909, 73.8278),
    "thiruvananthapuram": (8.5241, 76.9366),
    "mangalore": (12.8703, 74.8421),
    "mysore": (12.2958, 76.6394), "mysuru": (12.2958, 76.6394),
    "hubli": (15.3647, 75.1240),
    "vijayawada": (16.5062, 80.6480),
    "madurai": (9.9252, 78.1198),
    "rajkot": (22.3039, 70.8022),
    "bikaner": (28.0229, 73.3119),
    "ajmer": (26.4499, 74.6399),
    "siliguri": (26.7271, 88.3953),
    "faridabad": (28.4089, 77.3178),
    "gurgaon": (28.4595, 77.0266), "gurugram": (28.4595, 77.0266),
    "noida": (28.5355, 77.3910),
    "thane": (19.2183, 72.9781),
    "nashik": (19.9975, 73.7898),
    "aurangabad": (19.8762, 75.3433),
    "solapur": (17.6599, 75.9064),
    "kanchipuram": (12.8185, 79.6947),
    "pondicherry": (11.9416, 79.8083), "puducherry": (11.9416, 79.8083),
    "salem": (11.6643, 78.1460),
    "trichy": (10.7905, 78.7047), "tiruchirappalli": (10.7905, 78.7047),
    "medak": (18.0490, 78.2630),
    "nadia": (23.4700, 88.5500),
    "raigarh": (21.8974, 83.3950),
    "anekal": (12.7100, 77.6970),
    "guntur": (16.2991, 80.4575),
    "nellore": (14.4426, 79.9865),
}

# Model feature lists (order matters for the assembled vector).
CORE_FEATURES = [
    "TRANSPORTATION_DISTANCE_IN_KM", "day_of_week", "month", "lane_popularity",
    "route_risk", "driver_delay_rate", "is_return_trip", "is_deadhead",
]
EXTENDED_FEATURES = ["is_peak_month", "distance_category", "lane_maturity", "is_market"]
V7_FEATURES = [
    "TRANSPORTATION_DISTANCE_IN_KM", "day_of_week", "month", "delay_flag", "lane_popularity",
    "risk_score", "driver_delay_rate", "route_risk", "is_return_trip", "is_deadhead", "is_regular",
]
DELAY_PROB_COL = "predicted_delay_prob"
