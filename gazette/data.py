"""Fixed values that have to be as they are for right results."""

# What a word of a search or of a listing's text stands for, in natural order.
SYNONYMS = {
    "hydrerabad": "hyderabad", "hydrabad": "hyderabad", "hyderbad": "hyderabad", "hydrabaad": "hyderabad",
    "hyd": "hyderabad", "hyderabad": "hyderabad", "bangalore": "bengaluru", "banglore": "bengaluru",
    "bengluru": "bengaluru", "bengaluru": "bengaluru", "blr": "bengaluru", "bombay": "mumbai",
    "mumbai": "mumbai", "bombai": "mumbai", "bom": "mumbai", "poona": "pune",
    "pune": "pune", "delhi": "delhi", "newdelhi": "delhi", "gurgaon": "gurugram",
    "gurugram": "gurugram", "ncr": "delhi", "noida": "noida", "madras": "chennai",
    "chennai": "chennai", "calcutta": "kolkata", "kolkata": "kolkata", "ahmdabad": "ahmedabad",
    "ahmedabad": "ahmedabad", "amdavad": "ahmedabad", "allahabad": "prayagraj", "prayagraj": "prayagraj",
    "banaras": "varanasi", "benares": "varanasi", "kashi": "varanasi", "varanasi": "varanasi",
    "chandigrh": "chandigarh", "chandigarh": "chandigarh", "jaypur": "jaipur", "jaipur": "jaipur",
    "indor": "indore", "indore": "indore", "cochin": "kochi", "kochi": "kochi",
    "calicut": "kozhikode", "kozhikode": "kozhikode", "trichy": "tiruchirappalli", "tiruchirappalli": "tiruchirappalli",
    "vizag": "visakhapatnam", "visakhapatnam": "visakhapatnam", "trivandrum": "thiruvananthapuram", "thiruvananthapuram": "thiruvananthapuram",
    "iiith": "iiit hyderabad", "iiit-h": "iiit hyderabad", "iiitb": "iiit bengaluru", "iiit-b": "iiit bengaluru",
    "iiitd": "iiit delhi", "iiit-d": "iiit delhi", "iiita": "iiit prayagraj", "iiit-a": "iiit prayagraj",
    "iiitm": "iiit gwalior", "iitb": "iit bombay", "iit-b": "iit bombay", "iitd": "iit delhi",
    "iit-d": "iit delhi", "iitm": "iit madras", "iit-m": "iit madras", "iitk": "iit kanpur",
    "iit-k": "iit kanpur", "iitkgp": "iit kharagpur", "iit-kgp": "iit kharagpur", "iitr": "iit roorkee",
    "iit-r": "iit roorkee", "iitg": "iit guwahati", "iit-g": "iit guwahati", "iith": "iit hyderabad",
    "iitbhu": "iit varanasi", "iit-bhu": "iit varanasi", "nitt": "nit tiruchirappalli", "nit-t": "nit tiruchirappalli",
    "nitk": "nit surathkal", "nit-k": "nit surathkal", "nitw": "nit warangal", "nit-w": "nit warangal",
    "nitc": "nit calicut", "nitr": "nit rourkela", "bitsp": "bits pilani", "bitsg": "bits goa",
    "bitsh": "bits hyderabad", "coep": "coep pune", "pict": "pict pune", "vjti": "vjti mumbai",
    "dtu": "dtu delhi", "nsut": "nsut delhi", "iisc": "iisc bengaluru",
}

# The fields of a listing that a search looks at, in this order.
SEARCH_FIELDS = ("title", "organizer", "source", "platforms", "venue", "location", "college_name", "college_type", "city", "description", "tagline", "opportunity_type", "tags")

# Patterns of prizes in prose, in the order they are tried; group 1 is the prize.
PRIZE_PATTERNS = (
    "(?i)(?:prize\\s*(?:pool|worth)?|prizes?\\s*(?:worth)?|total\\s*prizes?)\\s*[:\\-–]?\\s*(₹[\\d,.\\s]+(?:lakh|lac|crore|cr|k)?)",
    "(?i)(₹[\\d,.\\s]+(?:lakh|lac|crore|cr|k)?)\\s*(?:prize|cash|worth)",
    "(?i)(?:prize|cash|worth)\\s*[:\\-–]?\\s*(\\$[\\d,.\\s]+(?:k|K)?)",
    "(?i)(₹[\\d,.\\s]+)\\s*(?:lakh|lac|crore|cr)",
    "(?i)(?:win|earn)\\s+(?:up\\s+to\\s+)?(₹[\\d,.\\s]+(?:lakh|lac|crore|cr|k)?)",
)
# Platforms whose names end the titles of their pages.
TITLE_PLATFORMS = ("Devfolio", "Unstop", "Devpost", "HackerEarth", "MLH", "Eventbrite", "Luma", "KonfHub")
# Values of fields that mean "not known".
UNKNOWN_VALUES = ("", "TBA", "Unknown")
# Fields that are counted or stamped, and never in conflict.
METADATA_FIELDS = ("scraped_at", "last_seen_at", "total_registrations", "registrations")

# Campuses of the institutes of a family, in natural order.
IIT_CAMPUSES = (
    "bombay", "delhi", "madras", "kanpur", "kharagpur", "roorkee", "guwahati", "hyderabad", "indore",
    "bhu", "varanasi", "dhanbad", "ism", "ropar", "rupnagar", "patna", "bhubaneswar", "mandi", "jodhpur",
    "tirupati", "palakkad", "dharwad", "bhilai", "goa", "jammu",
)
NIT_CAMPUSES = (
    "trichy", "tiruchirappalli", "surathkal", "warangal", "rourkela", "calicut", "jamshedpur",
    "kurukshetra", "hamirpur", "raipur", "durgapur", "allahabad", "prayagraj", "nagpur", "silchar",
    "srinagar", "jaipur", "bhopal", "patna", "agartala", "arunachal", "delhi", "goa", "manipur",
    "meghalaya", "mizoram", "nagaland", "puducherry", "sikkim", "uttarakhand",
)
IIIT_CAMPUSES = (
    "hyderabad", "bangalore", "bengaluru", "delhi", "allahabad", "prayagraj", "gwalior", "jabalpur",
    "kancheepuram", "lucknow", "kurnool", "sri city", "vadodara", "sonepat", "nagpur", "pune",
    "ranchi", "una", "kalyani", "bhopal", "dharwad", "tiruchirappalli", "trichy", "kottayam",
    "manipur", "raichur", "agartala", "bhagalpur", "surat",
)
BITS_CAMPUSES = ("pilani", "goa", "hyderabad", "dubai")

# What stands before the date on which a registration ends, and the forms of such a date.
REGISTRATION_LABEL = "(?i)(?:registration\\s+(?:deadline|closes|ends)|apply\\s+by|last\\s+date\\s+to\\s+register)\\s*[:–—-]?\\s*"
LABELLED_DATE = "(?i)^(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}(?:st|nd|rd|th)?\\s+[A-Za-z]+\\s+\\d{4}|[A-Za-z]+\\s+\\d{1,2}(?:st|nd|rd|th)?,?\\s+\\d{4})"
DATE_RANGE = "(?i)^\\s*(?:[-–—]|to\\b|through\\b|until\\b|and\\b)\\s*\\d"
