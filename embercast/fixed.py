"""Fixed values that results depend on (names, boxes, thresholds, label texts).

These are domain constants, stated once here in natural order; operators take
them as default arguments so callers can override each one.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — must stay equal to the modelled system for equal results.
# ---------------------------------------------------------------------------

# Target column names in the two vocabularies the system uses.
TARGET = "incendio"
TARGET_API = "Incendio"

# The 24 scoring features, in the order the scoring model expects them.
SCORING_FEATURES = [
    "temp_2m_mean", "temp_2m_max", "temp_2m_min",
    "relative_humidity_mean", "relative_humidity_min", "relative_humidity_max",
    "soil_moisture_7_28cm", "soil_moisture_28_100cm", "soil_temp_100_255cm",
    "direct_shortwave_radiation", "evapotranspiration", "vapor_pressure_deficit",
    "cloud_cover_high", "precipitation_sum", "wind_speed_mean", "wind_speed_max",
    "surface_pressure", "dew_point", "radiation_diffuse", "temperature_range",
    "humidity_range", "day_of_year", "month", "is_dry_season",
]

# Daily weather reply: source array name -> output column name.
DAILY_RENAME = {
    "temperature_2m_mean": "Temperature",
    "temperature_2m_max": "Temperature_Max",
    "temperature_2m_min": "Temperature_Min",
    "relative_humidity_2m": "Relative_Humidity",
    "precipitation_sum": "Precipitation",
    "shortwave_radiation_sum": "Solar_Radiation",
    "et0_fao_evapotranspiration": "Evapotranspiration",
    "vapor_pressure_deficit_mean": "Vapor_Pressure_Deficit",
}

# Hot-spot study box (inclusive on every edge) and the confidence floor.
BBOX_WEST, BBOX_SOUTH, BBOX_EAST, BBOX_NORTH = -66.5, -17.6, -65.8, -17.1
MIN_CONFIDENCE = 80

# Dry-season months (1 = January) and the southern-hemisphere seasons.
DRY_SEASON_MONTHS = [5, 6, 7, 8, 9, 10]
SEASONS = [
    ("verano", [12, 1, 2]),
    ("otoño", [3, 4, 5]),
    ("invierno", [6, 7, 8]),
    ("primavera", [9, 10, 11]),
]

# Prediction label texts.
LABEL_FIRE = "incendio"
LABEL_NO_FIRE = "sin_incendio"

# Four-level risk bucket on P(fire): lower bounds, highest first; NULL -> unknown.
RISK4 = [(0.75, "critico"), (0.50, "alto"), (0.25, "medio"), (0.0, "bajo")]
RISK_UNKNOWN = "desconocido"

# Three-level bucket used by the worked example: upper bounds, lowest first.
RISK3 = [(0.30, "BAJO"), (0.60, "MEDIO"), (None, "ALTO")]

# Risk level -> display colour and advice heading/lines.
RISK_ADVICE = [
    ("bajo", "#28a745", "CONDICIONES FAVORABLES", [
        "Mantener prácticas de prevención habituales",
        "Continuar monitoreo de condiciones",
        "Seguir protocolos establecidos",
    ]),
    ("medio", "#ffc107", "PRECAUCIÓN", [
        "Extremar medidas de prevención",
        "Monitorear condiciones meteorológicas",
        "Preparar planes de contingencia",
        "Mantener comunicación con autoridades",
    ]),
    ("alto", "#fd7e14", "ALERTA DE ALTO RIESGO", [
        "Evitar actividades que puedan generar chispas",
        "Mantener vigilancia constante",
        "Tener equipos de extinción preparados",
        "Notificar a autoridades competentes",
        "Restringir acceso a zonas forestales",
    ]),
    ("critico", "#dc3545", "ALERTA DE ALTO RIESGO", [
        "Evitar actividades que puedan generar chispas",
        "Mantener vigilancia constante",
        "Tener equipos de extinción preparados",
        "Notificar a autoridades competentes",
        "Restringir acceso a zonas forestales",
    ]),
    ("desconocido", "#6c757d", "SIN DATOS", []),
]

# Monitor defaults: retained readings and alert threshold on P(fire).
MONITOR_HISTORY = 100
ALERT_THRESHOLD = 0.7

# Random-search space (sklearn names -> candidate values); None depth = unbounded.
SEARCH_SPACE = {
    "n_estimators": [100, 200, 300, 400],
    "max_depth": [10, 20, 30, None],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2", None],
    "bootstrap": [True, False],
    "class_weight": ["balanced", "balanced_subsample"],
}

# Outlier thresholds: flagging (sample std) and removal (population std).
OUTLIER_FLAG_THRESHOLD = 3.0
OUTLIER_REMOVE_THRESHOLD = 3.0
MODEL_READY_OUTLIER_THRESHOLD = 3.5
