"""Parameters of the registered queries.

The reference's durations are tuned to a live feed with a position every
few seconds; in the test tables one aircraft reports every ~7 hours, so the
registered queries use scaled durations (FIXTURES.md B). Operators take all
of them as arguments; the reference's own values are used in unit tests.
"""

AS_OF = "2024-01-31 00:00:00"

LIVE_MAX_AGE = "6 hours"          # reference: 2 minutes
FALLBACK_SPAN = "12 hours"        # reference: 30 seconds
TRAIL_SPAN = "10 days"            # reference: 15 minutes
TRAIL_POINTS = 15
FULL_FLIGHT_LOOKBACK = "48 hours"
FULL_FLIGHT_DEFAULT = "24 hours"
RETENTION = "7 days"              # reference: 24 hours (topic)
ROUTE_TTL = "12 hours"
SUBSCRIPTION_TTL = "24 hours"
ALERT_WINDOW_MIN = 65
ROLLING_TRAIL_POINTS = 20
BBOX = (24.0, 50.0, -125.0, -66.0)  # min_lat, max_lat, min_lon, max_lon

# Reference values (used by literal tests and available to callers).
REF_LIVE_MAX_AGE = "2 minutes"
REF_FALLBACK_SPAN = "30 seconds"
REF_TRAIL_SPAN = "15 minutes"
