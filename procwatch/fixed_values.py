"""Fixed values.

Everything in this file is a constant that results depend on: bands, names,
wordings, patterns, formats. It holds no logic.
"""

# Monitored parameters, in their natural order.
PARAMETERS = [
    {
        "id": "temp", "name": "Reactor Temperature", "short": "Temperature",
        "unit": "degC", "asset": "BR-12",
        "control": (36.5, 37.5), "alarm": (36.0, 38.0), "trip": (35.5, 38.5),
        "baseline": 37.0,
        "features": ["coolant_flow_rate", "jacket_temperature", "steam_valve_position",
                     "heat_exchanger_dp", "agitator_torque"],
        "primary_driver": "coolant_flow_rate",
        "root_cause": "Cooling-water flow fluctuation / heat-exchanger fouling",
        "model": "gbm", "value_column": "reactor_temperature_degc",
    },
    {
        "id": "ph", "name": "pH", "short": "pH",
        "unit": "pH", "asset": "BR-12",
        "control": (6.8, 7.2), "alarm": (6.6, 7.4), "trip": (6.4, 7.6),
        "baseline": 7.0,
        "features": ["acid_base_dose_rate", "co2_accumulation", "agitator_speed",
                     "probe_drift_mv", "dissolved_oxygen"],
        "primary_driver": "acid_base_dose_rate",
        "root_cause": "Acid/base dosing lag / valve actuation delay",
        "model": "random_forest", "value_column": "ph",
    },
    {
        "id": "press", "name": "Differential Pressure", "short": "Pressure",
        "unit": "kPa", "asset": "FIL-07",
        "control": (100.0, 110.0), "alarm": (96.0, 114.0), "trip": (92.0, 118.0),
        "baseline": 105.0,
        "features": ["filter_dp", "gas_exhaust_flow", "pump_speed_hz",
                     "valve_position", "seal_integrity_index"],
        "primary_driver": "filter_dp",
        "root_cause": "Filter blockage / gas-exhaust restriction",
        "model": "gbm", "value_column": "differential_pressure_kpa",
    },
    {
        "id": "cond", "name": "Conductivity (WFI)", "short": "Conductivity",
        "unit": "uS/cm", "asset": "WFI-02",
        "control": (700.0, 900.0), "alarm": (640.0, 960.0), "trip": (600.0, 1000.0),
        "baseline": 800.0,
        "features": ["water_flow_rate", "resin_bed_dp", "regeneration_cycle_count",
                     "toc_level", "feed_composition"],
        "primary_driver": "feed_composition",
        "root_cause": "Salt / nutrient feed composition error",
        "model": "svm", "value_column": "conductivity_us_cm",
    },
    {
        "id": "hum", "name": "Humidity (Cleanroom)", "short": "Humidity",
        "unit": "pct", "asset": "CR-A1",
        "control": (40.0, 55.0), "alarm": (36.0, 59.0), "trip": (32.0, 63.0),
        "baseline": 47.0,
        "features": ["hvac_fan_speed", "cooling_coil_temp", "hepa_dp",
                     "outdoor_humidity", "door_open_count"],
        "primary_driver": "hvac_fan_speed",
        "root_cause": "HVAC coil / HEPA filter inefficiency",
        "model": "ann", "value_column": "humidity_pct",
    },
]
PARAM_IDS = [p["id"] for p in PARAMETERS]

# The breach query.
WINDOW_SIZE = "10 seconds"
WATERMARK = "5 seconds"
BREACH_THRESHOLD = 0.30
ESIGN_PROBABILITY = 0.80
SCORE_OFFSET = 0.30
SCORE_SPAN = 0.85
VOLATILITY_CAP = 0.5
VOLATILITY_WEIGHT = 0.35
MIN_HALF_WIDTH = 1e-9

# Training.
ROLLING_ROWS = 10
HORIZON_ROWS = 15
TEST_SHARE = 0.25
SEED = 42

# The learners of the models.
BOOSTING = {"maxIter": 220, "maxDepth": 4, "stepSize": 0.08, "subsamplingRate": 0.9}
FOREST = {"numTrees": 300, "maxDepth": 10, "minInstancesPerNode": 5}
NETWORK_LAYERS = [64, 32]
NETWORK = {"maxIter": 600, "tol": 1e-4}
KERNEL_COST = 2.0

# Chunking, vectors and ranking.
CHUNK_WORDS = 220
CHUNK_OVERLAP = 40
VECTOR_SIZE = 384
MIN_NORM = 1e-9
ALPHA = 0.6
TOP_K = 6
POOL_FACTOR = 4
POOL_MIN = 20
SUBQUESTION_TOP_K = 4
MMR_LAMBDA = 0.72
RRF_BASE = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# The white space that ends a word (as a regular-expression class).
WHITE_SPACE = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Document kinds, in the order in which they are looked for.
SOURCE_KINDS = ["maintenance", "deviation", "batch", "capa", "sop", "oem"]

# One sentence per record kind; {x} is column x, {x|d} has default d.
CAPA_TEMPLATE = (
    "CAPA record {capa_id} for {parameter} on asset {asset}, opened {opened}. "
    "Problem: {problem} Root cause: {root_cause} "
    "Corrective action taken: {corrective_action} Effectiveness: {effectiveness}. "
    "Recurrence after action: {recurrence|none recorded}.")
MAINTENANCE_TEMPLATE = (
    "Maintenance work order {wo_id} on {asset} ({component}) completed {completed}. "
    "Trigger: {trigger}. Action: {action}. Findings: {findings}. "
    "Downtime: {downtime_min} minutes. Technician note: {note|-}")
BATCH_TEMPLATE = (
    "Batch record {batch_id} for molecule {molecule}, phase {phase}. "
    "Parameter {parameter} held {setpoint} with observed range {observed_range}. "
    "Deviations: {deviations|none}. Disposition: {disposition}.")

# The three questions asked about a breach (intent, wording, source types).
SUB_QUESTIONS = [
    ("sop",
     "What is the approved corrective procedure when {name} on {asset} goes {direction} "
     "its control band of {control_lo}-{control_hi} {unit}?",
     ["sop"]),
    ("capa",
     "What prior CAPA records exist for {name} excursions on {asset}, and which "
     "corrective actions were effective?",
     ["capa"]),
    ("oem",
     "What do the OEM manual and maintenance history say about {driver} affecting {name}?",
     ["oem", "maintenance"]),
]

# Procedure steps in text.
STEP_PATTERN = r"Step\s+\d+\.\s*([^\n]+?)(?=\s*Step\s+\d+\.|\z)"
NUMBERED_LINE = r"^(\d+)[.)]\s*(.+)$"
STEP_MIN_CHARS = 20
STEP_MAX_CHARS = 300
STEP_KEY_CHARS = 60
STEPS_PER_CARD = 4
STEPS_PER_TEXT = 5
CONTEXT_CHUNKS = 6
NO_STEP_ACTION = ("No approved procedure retrieved for this {name} condition. "
                  "Escalate to QA and record a deviation.")
NO_STEP_CITATION = "ESCALATION-DEFAULT"

# Reasons given by the card's signature rule and by the policy table.
REASON_DENIED = "RBAC denied: agent lacks the required execute role"
REASON_PH = "SOP-PH-009: all pH setpoint changes require QA e-signature"
REASON_TRIP = "Trip-zone excursion — QA review obligation"
REASON_HIGH = "High predicted breach probability (>= 0.80)"
REASON_MICRO = "Micro-adjustment within policy"
CARD_REASON_HIGH = "High predicted breach probability (>=0.80)"
CARD_REASON_MICRO = ("Micro-adjustment within policy — operator signature captured "
                     "for traceability")

# Audit chain start, signature limits.
GENESIS = "GENESIS"
SIGNER_MIN_CHARS = 3
REASON_MIN_CHARS = 4

# Roles and descriptions of data-set columns.
METADATA_COLUMNS = ["timestamp", "batch_id", "asset", "zone"]
LABEL_COLUMN = "breach_within_15"
DATETIME_PATTERN = r"\d{4}-\d{2}-\d{2}|T\d{2}:"
COLUMN_DESCRIPTIONS = {
    "timestamp": "Event time of the SCADA sample (ISO-8601 / wall-clock).",
    "batch_id": "Manufacturing batch or lot identifier associated with the reading.",
    "asset": "Equipment tag where the sensor reading was collected.",
    "zone": "Operating zone classification at sample time (control / alarm / trip).",
    "breach_within_15": "Binary label: whether a control-band breach occurs within the next "
                        "15 minutes (PdM target).",
    "reactor_temperature_degc": "Dependent variable — bioreactor temperature in °C.",
    "ph": "Dependent variable — culture / media pH.",
    "differential_pressure_kpa": "Dependent variable — filter differential pressure in kPa.",
    "conductivity_us_cm": "Dependent variable — WFI conductivity in µS/cm.",
    "humidity_pct": "Dependent variable — cleanroom relative humidity in %.",
    "coolant_flow_rate": "Jacket / cooling-water flow rate influencing reactor temperature.",
    "jacket_temperature": "Cooling-jacket temperature setpoint or measured jacket °C.",
    "steam_valve_position": "Steam utility valve position (% open) contributing to heat input.",
    "heat_exchanger_dp": "Heat-exchanger differential pressure (fouling indicator).",
    "agitator_torque": "Agitator motor torque (mixing intensity and viscosity proxy).",
    "acid_base_dose_rate": "Acid/base dosing pump rate used for pH control.",
    "co2_accumulation": "Dissolved / headspace CO₂ accumulation affecting pH.",
    "agitator_speed": "Agitator RPM contributing to gas transfer and mixing.",
    "probe_drift_mv": "pH probe millivolt drift from last calibration.",
    "dissolved_oxygen": "Dissolved oxygen level interacting with culture metabolism / pH.",
    "filter_dp": "Filter differential pressure contributing to overall ΔP.",
    "gas_exhaust_flow": "Exhaust gas flow rate (vent path restriction indicator).",
    "pump_speed_hz": "Transfer / recirculation pump drive frequency (Hz).",
    "valve_position": "Process valve position affecting pressure drop across the train.",
    "seal_integrity_index": "Seal health index for pressure-boundary components.",
    "water_flow_rate": "WFI loop volumetric flow rate.",
    "resin_bed_dp": "Deionization resin-bed differential pressure.",
    "regeneration_cycle_count": "Number of resin regeneration cycles since last replacement.",
    "toc_level": "Total organic carbon level in the WFI stream.",
    "feed_composition": "Feed-water composition index affecting conductivity.",
    "hvac_fan_speed": "HVAC supply / recirculation fan speed.",
    "cooling_coil_temp": "Cooling-coil temperature influencing room humidity.",
    "hepa_dp": "HEPA filter differential pressure.",
    "outdoor_humidity": "Outdoor ambient humidity loading the HVAC system.",
    "door_open_count": "Cleanroom door-open events in the sampling window.",
}
FEATURE_DESCRIPTION = "Independent process driver for {name} PdM model."
OTHER_DESCRIPTION = "Process / context variable: {pretty}."
