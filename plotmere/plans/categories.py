"""Fixed values of the classification: categories of business and the word and tag lists of its rules."""

from __future__ import annotations

from typing import NamedTuple


class Category(NamedTuple):
    key: str
    label: str
    weight: int
    types: list[str] = []
    tags: list[tuple[str, str | None]] = []
    aliases: list[str] = []
    words: list[str] = []
    lead_type: str = "Prospect"


# The categories, in the order that decides ties. A tag without a value stands for any value.
CATEGORIES = [
    Category("grocery", "Grocery / supermarket", 35,
        ["supermarket", "grocery_store", "hypermarket", "discount_supermarket"],
        [("shop", "supermarket")],
        ["grocery", "intlgrocery", "organic_stores", "healthmarkets"],
        ["supermarket", "grocery", "groceries", "food 4 less", "market place"]),
    Category("wholesale", "Warehouse club / wholesale", 34,
        ["warehouse_store", "wholesaler"],
        [("shop", "wholesale")],
        ["wholesale_stores", "wholesalers", "suppliesrestaurant"],
        ["wholesale", "wholesalers", "warehouse club"]),
    Category("big_box", "Big-box / department / home improvement", 32,
        ["department_store", "home_improvement_store"],
        [("shop", "department_store"), ("shop", "doityourself")],
        ["deptstores", "buildingsupplies"],
        ["supercenter", "home improvement"]),
    Category("specialty_retail", "Mid-size retail (electronics, sporting goods, furniture, hardware, discount)", 15,
        ["discount_store", "hardware_store", "furniture_store", "sporting_goods_store", "electronics_store", "home_goods_store"],
        [("shop", v) for v in ("furniture", "hardware", "variety_store", "electronics", "sports", "outdoor", "second_hand", "charity", "appliance", "craft")],
        ["discountstore", "hardware", "homeandgarden", "gardening", "furniture", "mattresses", "homedecor", "electronics", "computers",
         "appliances", "sportgoods", "outdoorgear", "thrift_stores", "artsandcrafts", "fabricstores", "hobbyshops", "officeequipment"],
        ["thrift store", "thrift stores", "thrift shop", "deseret industries"]),
    Category("distribution", "Warehouse / distribution / logistics", 34,
        [],
        [("building", "warehouse"), ("industrial", "warehouse"), ("industrial", "logistics"), ("office", "logistics"), ("landuse", "logistics"), ("amenity", "post_depot")],
        [],
        ["distribution", "distributing", "distributor", "distributors", "warehouse", "warehouses", "warehousing", "logistics", "fulfillment",
         "cold storage", "freight", "supply chain", "3pl"]),
    Category("food_production", "Food & beverage production", 32,
        [],
        [("industrial", "food"), ("industrial", "brewery"), ("craft", "brewery"), ("industrial", "bakery"), ("industrial", "dairy"), ("industrial", "slaughterhouse"), ("craft", "distillery")],
        [],
        ["foods", "food processing", "meats", "meat packing", "dairy", "bottling", "beverage", "beverages", "brewing", "creamery", "bakeries",
         "packing plant", "packing house", "packinghouse", "packing company", "fruit packing", "produce packing"]),
    Category("manufacturing", "Manufacturing / industrial", 28,
        ["manufacturer"],
        [("man_made", "works"), ("building", "industrial"), ("building", "manufacture"), ("industrial", None), ("landuse", "industrial")],
        ["machineshops", "metalfabricators"],
        ["manufacturing", "manufacturer", "manufacturers", "mfg", "industries", "fabrication", "plastics", "packaging", "printing", "corrugated",
         "machining", "assembly plant", "manufacturing plant"]),
    Category("healthcare", "Hospital / medical center", 28,
        ["hospital", "general_hospital"],
        [("amenity", "hospital"), ("healthcare", "hospital")],
        ["hospitals"],
        ["hospital", "medical center", "regional medical"]),
    Category("venue", "Mall / stadium / arena / airport / convention", 28,
        ["shopping_mall", "stadium", "arena", "airport", "convention_center", "amusement_park", "event_venue"],
        [("shop", "mall"), ("leisure", "stadium"), ("aeroway", "aerodrome"), ("amenity", "conference_centre"), ("amenity", "exhibition_centre"), ("tourism", "theme_park")],
        ["shoppingcenters", "stadiumsarenas", "airports", "airportterminals", "amusementparks", "waterparks", "civiccenter"],
        ["mall", "stadium", "arena", "international airport", "convention center", "expo center", "fashion place", "town center"]),
    Category("recycling", "Recycling / waste facility", 30,
        [],
        [("amenity", "recycling"), ("amenity", "waste_transfer_station"), ("industrial", "scrap_yard"), ("industrial", "auto_wrecker"), ("shop", "scrap"), ("landuse", "landfill"), ("amenity", "waste_disposal")],
        ["recyclingcenter", "junkyards", "hazardouswastedisposal"],
        ["recycling", "recycler", "recyclers", "recycle", "recycled", "waste", "disposal", "sanitation", "transfer station", "landfill", "scrap", "salvage"],
        "Waste / recycling facility"),
    Category("education", "University / college", 20,
        ["university"],
        [("amenity", "university"), ("amenity", "college")],
        ["collegeuniv"],
        ["university", "college", "community college"]),
    Category("hospitality", "Hotel / resort", 18,
        ["hotel", "resort_hotel", "lodging", "casino"],
        [("tourism", "hotel")],
        ["hotels", "resorts", "casinos", "skiresorts"],
        ["hotel", "resort", "marriott", "hilton", "hyatt", "sheraton"]),
    Category("multifamily", "Apartment complex / property", 15,
        ["apartment_complex", "apartment_building", "housing_complex", "condominium_complex"],
        [("building", "apartments"), ("landuse", "residential")],
        ["apartments", "condominiums", "university_housing"],
        ["apartments", "apartment homes", "residences", "lofts", "property management"]),
    Category("institutional", "Government / correctional / military", 15,
        ["city_hall", "courthouse", "local_government_office"],
        [("amenity", "prison"), ("landuse", "military"), ("military", None)],
        ["jailsandprisons", "courthouses", "townhall"],
        ["correctional", "prison", "detention", "air force base", "county complex"]),
    Category("food_service", "Restaurant / food service", 8,
        ["restaurant", "meal_takeaway", "cafeteria", "catering_service", "food_court", "fast_food_restaurant", "bakery", "brewery", "winery",
         "brewpub", "bar", "pub", "cafe", "coffee_shop", "ice_cream_shop"],
        [("amenity", v) for v in ("restaurant", "food_court", "fast_food", "pub", "bar", "cafe", "ice_cream")] + [("shop", "bakery")],
        ["restaurants", "hotdogs", "hotdog", "food_court", "cafeteria", "catering", "buffets", "foodtrucks", "foodstands", "cafes", "coffee",
         "icecream", "desserts", "donuts", "bagels", "juicebars", "bubbletea", "tea", "sandwiches", "delis", "pizza", "burgers", "chicken_wings",
         "breakfast_brunch", "diners", "tradamerican", "newamerican", "mexican", "tacos", "chinese", "italian", "sushi", "seafood", "steak",
         "bars", "pubs", "sportsbars", "divebars", "cocktailbars", "wine_bars", "beerbar", "lounges", "gastropubs", "beergardens", "brewpubs",
         "bakeries", "breweries", "distilleries", "wineries", "cideries", "meaderies", "coffeeroasteries"],
        ["catering", "commissary", "food service"]),
    Category("retail", "Other retail", 8,
        ["clothing_store", "pet_store", "book_store", "auto_parts_store", "liquor_store"],
        [("shop", v) for v in ("clothes", "pet", "car_parts", "general", "books")],
        ["fashion", "womenscloth", "menscloth", "childcloth", "shoes", "sportswear", "outlet_stores", "petstore", "bookstores", "media",
         "autopartssupplies", "beer_and_wine", "toys"],
        []),
    Category("equipment", "Compactor / baler equipment or service", 10,
        [],
        [],
        ["junkremovalandhauling", "dumpsterrental"],
        ["compactor", "compactors", "compaction", "baler", "balers", "baling", "dumpster", "dumpsters", "roll off", "roll-off", "roll offs",
         "roll-offs", "hauling", "disposal service", "disposal services"],
        "Industry (equipment / hauler)"),
]
BY_KEY = {c.key: c for c in CATEGORIES}

# Word and tag lists of the rules.
NOT_CAMPUS = [
    "garden", "gardens", "house", "home", "homes", "residence", "residences", "heights", "condominium", "condominiums", "condo", "condos",
    "apartments", "townhomes", "village", "department", "dept", "press", "institute", "center for", "centre for", "office", "offices",
    "bookstore", "library", "museum", "parking", "credit union", "alumni", "foundation", "club", "chapel", "church", "ward", "stake", "lab",
    "laboratory", "laboratories", "clinic", "preschool", "child care", "daycare", "observatory", "park", "station", "president's house",
    "presidents house",
]
NOT_CAMPUS_INNER = ["college of", "school of"]
GENERIC_TAGS = [("industrial", None), ("building", "industrial"), ("landuse", "industrial"), ("landuse", "residential")]
LARGE_SITE_TAGS = [("landuse", "military"), ("military", None), ("aeroway", "aerodrome"), ("amenity", "university"), ("amenity", "college")]
LARGE_SITE_TYPES = ["airport", "university", "yelp:airports", "yelp:collegeuniv"]
SMALL_FOOD_SHOP = [
    "barn", "shop", "shoppe", "store", "market", "mart", "cafe", "deli", "bar", "grill", "kitchen", "diner", "stand", "queen", "freeze",
    "drive in", "treats", "ice cream", "corner", "express", "restaurant", "eatery", "bistro",
]
NON_PROSPECT_TAGS = [
    ("amenity", v)
    for v in (
        "veterinary", "parking", "parking_entrance", "pharmacy", "clinic", "doctors", "dentist", "fuel", "library", "shelter", "school",
        "kindergarten", "place_of_worship", "bank", "atm", "police", "fire_station", "parcel_locker", "vehicle_impound", "parking_space",
    )
] + [
    ("aeroway", "helipad"), ("aeroway", "heliport"), ("tourism", "artwork"), ("tourism", "information"), ("leisure", None),
    ("healthcare", None), ("building", "parking"), ("building", "construction"), ("landuse", "construction"),
]
NON_PROSPECT_WORDS = [
    "police", "sheriff", "sheriffs", "fire department", "fire station", "fire training", "fire rescue", "impound", "tow yard",
    "towing yard", "trailer yard", "trailer parking", "trailer storage", "truck parking", "truck yard", "parking lot", "park and ride",
    "fleet maintenance", "fleet management", "fleet services", "maintenance yard", "luxer", "luxer one", "parcel locker",
    "parcel lockers", "package locker", "package lockers", "amazon locker", "amazon hub",
]
NON_PROSPECT_TYPES = [
    "veterinary_care", "dentist", "dental_clinic", "doctor", "medical_clinic", "pharmacy", "drugstore", "church", "place_of_worship",
    "park", "parking", "gas_station", "library", "school", "primary_school", "secondary_school", "bank", "atm", "insurance_agency",
    "lawyer", "real_estate_agency", "beauty_salon", "hair_salon", "barber_shop", "car_repair", "car_wash", "health", "optician",
    "police", "fire_station",
]
NON_PROSPECT_ALIASES = [
    "vet", "emergencypethospital", "pharmacy", "drugstores", "dentists", "generaldentistry", "cosmeticdentists", "pediatric_dentists",
    "orthodontists", "physicians", "urgent_care", "walkinclinics", "optometrists", "opticians", "churches", "religiousorgs", "parks",
    "dog_parks", "parking", "servicestations", "autorepair", "carwash", "oilchange", "libraries", "elementaryschools", "highschools",
    "preschools", "privateschools", "montessori", "childcare", "banks", "insurance", "lawyers", "realestateagents", "apartmentagents",
    "hair", "barbers", "othersalons", "beautysvc", "selfstorage", "movers", "policedepartments", "firedepartments", "towing",
    "addictionmedicine", "allergist", "anesthesiologists", "audiologist", "cardiology", "cosmeticsurgeons", "dermatology",
    "earnosethroat", "emergencymedicine", "endocrinologists", "familydr", "fertility", "gastroenterologist", "geneticists",
    "gerontologist", "hepatologists", "hospitalists", "immunodermatologists", "infectiousdisease", "internalmed", "naturopathic",
    "nephrologists", "neurologist", "neuropathologists", "neurotologists", "obgyn", "oncologist", "opthamalogists", "orthopedists",
    "osteopathicphysicians", "otologists", "painmanagement", "pathologists", "pediatricians", "phlebologists", "plasticsurgeons",
    "podiatrists", "preventivemedicine", "proctologist", "psychiatrists", "pulmonologist", "radiologists", "rhematologists",
    "spinesurgeons", "sportsmed", "surgeons", "tattooremoval", "toxicologists", "underseamedicine", "urologists", "vascularmedicine",
]
UTILITY_TAGS = [
    ("man_made", "pumping_station"), ("man_made", "water_well"), ("man_made", "water_tower"), ("man_made", "reservoir_covered"),
    ("man_made", "storage_tank"), ("man_made", "street_cabinet"), ("man_made", "monitoring_station"), ("man_made", "telephone_office"),
    ("power", "substation"), ("power", "transformer"), ("power", "switch"), ("building", "transformer_tower"),
    ("building", "pumping_station"), ("pumping_station", None), ("substation", None), ("telecom", None), ("building", "data_center"),
    ("building", "data_centre"),
]
UTILITY_WORDS = [
    "well", "pump station", "pumping station", "pump house", "lift station", "booster station", "substation", "sub station",
    "water tank", "reservoir", "power and light", "power light", "pacificorp", "rocky mountain power", "dominion energy", "questar",
    "enbridge", "uta", "trax", "frontrunner", "city corp", "city corporation", "irrigation", "canal company", "water district",
    "water conservancy", "improvement district", "sewer district", "telephone", "centurylink", "qwest",
]
UTILITY_OPERATORS = [
    "city", "town", "county", "district", "state of utah", "utah department", "department of transportation", "udot", "uta",
    "utah transit authority", "power", "light", "energy", "gas", "water", "utility", "utilities", "pacificorp", "questar", "dominion",
    "enbridge", "irrigation", "canal", "sewer", "telephone", "centurylink", "qwest", "lumen",
]
SMALL_BUILDING_SQFT = 5000
SHOP_LIKE = ["store", "stores", "thrift", "outlet", "boutique", "showroom", "retail"]
RETAIL_TAGS = [("landuse", "retail")]
STORAGE_TAGS = [("shop", "storage_rental"), ("amenity", "storage_rental"), ("building", "storage_rental")]
STORAGE_TYPES = ["storage", "self_storage"]
STORAGE_WORDS = [
    "self storage", "selfstorage", "self-storage", "safe storage", "storage units", "storage unit", "mini storage", "ministorage",
    "rv storage", "boat storage", "storage rental", "storage rentals", "public storage", "extra space storage", "cubesmart",
    "u haul storage",
]
COLD_WORDS = ["cold", "frozen", "freezer", "refrigerated", "food", "foods", "grain", "bulk", "records", "document", "archive", "archives"]
LOGISTICS_WORDS = [
    "distribution", "distributing", "logistics", "fulfillment", "warehousing", "supply chain", "3pl", "freight", "transport",
    "transportation", "trucking", "shipping",
]
NOT_PLANT_WORDS = [
    "data center", "data centre", "datacenter", "data centers", "colocation", "flexential", "databank", "equinix", "digital realty",
    "cyrusone", "aligned data", "career center", "career centre", "job center", "employment center", "workforce services",
    "american job center", "city shops", "county shops", "public works", "city yard", "city yards", "county yard", "streets division",
    "street department", "road shed", "roads shed", "maintenance shops",
]
PARCEL_CARRIERS = [
    "amazon", "amazon logistics", "fedex", "fedex ground", "ups", "united parcel service", "usps", "united states postal service",
    "us postal service", "dhl", "ontrac", "lasership", "purolator",
]
PARCEL_STATIONS = [
    "home delivery", "delivery station", "delivery center", "delivery centre", "delivery hub", "delivery depot", "sort center",
    "sortation center", "sorting center", "sorting facility", "processing center", "processing and distribution", "ground hub",
    "customer center", "hub", "depot",
]
RETAIL_CHAINS = {
    "harbor freight": "specialty_retail", "harbor freight tools": "specialty_retail", "sportsman's warehouse": "specialty_retail",
    "sportsmans warehouse": "specialty_retail", "the container store": "specialty_retail", "mattress warehouse": "specialty_retail",
    "furniture warehouse": "specialty_retail", "shoe warehouse": "retail", "dsw designer shoe warehouse": "retail",
    "men's wearhouse": "retail",
}
MALL_WORDS = [
    "mall", "shopping center", "shopping centre", "shopping plaza", "plaza", "town center", "towne center", "town centre", "marketplace",
    "commons", "crossing", "outlets", "outlet mall", "galleria", "square", "promenade", "fashion place", "gateway", "station park",
    "city creek", "center", "centre", "village", "shops at", "the shops",
]
RESORT_WORDS = ["ski resort", "ski area", "summer resort", "mountain resort", "ski and summer resort"]
MALL_OWN_WORDS = ["mall", "shopping mall", "shopping center", "shopping centre", "outlet mall"]
SHOP_WORDS = [
    "furniture", "mattress", "mattresses", "appliance", "appliances", "store", "shop", "boutique", "showroom", "hardware", "tools",
    "carpet", "flooring", "rugs", "jewelers", "jewelry", "books", "home furnishings", "interiors", "decor", "gallery", "music", "pianos",
    "outdoor", "sports", "clothing",
]
CLINIC_WORDS = [
    "clinic", "clinics", "instacare", "urgent care", "outpatient", "health center", "health centre", "surgery center", "surgical center",
    "dialysis", "imaging center", "family medicine", "family practice",
]
SERVICE_PLANT_WORDS = [
    "generation plant", "generating plant", "generating station", "power plant", "power station", "central plant",
    "central utility plant", "utility plant", "heating plant", "cooling plant", "chiller plant", "chilled water plant", "steam plant",
    "boiler plant", "boiler house", "cogeneration", "energy plant", "thermal plant",
]
WASH_WORDS = [
    "car wash", "carwash", "car washes", "truck wash", "truckwash", "diesel wash", "auto wash", "vehicle wash", "bus wash", "rv wash",
    "semi wash", "fleet wash", "wash bay", "blue beacon",
]
WASH_TAGS = [("amenity", "car_wash")]
BUILDING_WORDS = [
    "office", "offices", "warehouse", "warehouses", "building", "buildings", "bldg", "industrial", "manufacturing", "plant", "factory",
    "shop", "shops", "storage", "hangar", "hangars", "garage", "garages", "annex", "facility", "facilities", "complex", "center",
    "centre", "dock", "docks", "loading", "maintenance", "flex", "space", "suite", "suites", "unit", "units", "tower", "wing", "hall",
    "yard", "distribution", "retail", "commercial", "business", "park",
]
FILLER_WORDS = [
    "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest", "upper", "lower", "main", "front", "rear",
    "back", "central", "new", "old", "mixed", "use", "light", "and", "the", "of", "with", "a", "no",
]
GENERIC_NAMES = [
    "recycling", "recycling center", "recycling centre", "recycling drop off", "recycling dropoff", "recycling drop-off",
    "recycling bins", "recycling containers", "recycle", "recycle center", "junkyard", "junk yard", "scrap yard", "scrapyard",
    "salvage yard", "landfill", "transfer station", "dump", "waste", "trash", "garbage", "compactor", "dumpster", "dumpsters",
    "warehouse", "storage", "self storage", "distribution center", "factory", "plant", "industrial", "industrial building",
    "manufacturing", "shop", "store", "hotel", "apartments", "hospital", "grocery", "supermarket", "mall",
]
RESCUE_TAGS = [("amenity", "recycling"), ("amenity", "waste_transfer_station"), ("landuse", "landfill")]
RESCUE_TYPES = ["waste_transfer_station", "recycling_center"]
NAME_BEATS_TYPE = {"real_estate_agency": ["multifamily"], "school": ["education"]}
GENERIC_TYPES = ["point_of_interest", "establishment", "premise", "food", "finance"]
PRODUCTION_TYPES = ["bakery", "brewery", "winery"]
SERVICE_TYPES = ["brewpub", "pub", "bar", "cafe", "coffee_shop", "meal_takeaway", "fast_food_restaurant", "ice_cream_shop", "restaurant"]
PRODUCTION_ALIASES = ["bakeries", "breweries", "distilleries", "wineries", "cideries", "meaderies", "coffeeroasteries"]
SERVICE_ALIASES = [a for a in BY_KEY["food_service"].aliases if a not in PRODUCTION_ALIASES]
PHRASE_CATEGORY = {
    "warehouse": "distribution", "distribution center": "distribution", "logistics company": "distribution",
    "fulfillment center": "distribution", "cold storage": "distribution", "manufacturer": "manufacturing",
    "manufacturing plant": "manufacturing", "printing company": "manufacturing", "packaging company": "manufacturing",
    "food processing plant": "food_production", "commercial bakery": "food_production", "beverage bottling": "food_production",
    "recycling center": "recycling", "waste transfer station": "recycling",
}

# Brands with a bonus, the places and words that are no brand, and those that need a second sign.
BRANDS = [
    "walmart", "wal mart", "sam's club", "sams club", "costco", "winco", "whole foods", "trader joe's", "albertsons", "kroger",
    "fred meyer", "the home depot", "home depot", "ikea", "ross dress for less", "tj maxx", "t.j. maxx", "hobby lobby",
    "dick's sporting goods", "sportsman's warehouse", "scheels", "rc willey", "r.c. willey", "deseret industries", "big lots", "petsmart",
    "petco", "nordstrom", "jcpenney", "intermountain medical center", "intermountain healthcare", "intermountain health",
    "university of utah hospital", "st. mark's hospital", "lds hospital", "primary children's", "mountainview hospital", "kodiak cakes",
    "lehi roller mills", "swire coca-cola", "coca-cola", "coca cola", "pepsi", "pepsico", "frito-lay", "frito lay", "kraft heinz",
    "dannon", "sysco", "us foods", "northrop grumman", "l3harris", "boeing", "hill air force base",
]
PLACE_BRANDS = ["hill air force base", "intermountain medical center", "university of utah hospital"]
LOCATION_WORDS = ["near", "at", "by", "across from", "behind", "next to", "inside", "off", "opposite"]
AMBIGUOUS_BRANDS = (
    dict.fromkeys(["smith's", "smiths", "lin's", "ridley's", "macey's", "maceys", "harmons", "fresh market", "sprouts"], ["grocery"])
    | dict.fromkeys(
        ["target", "lowe's", "lowes", "kohl's", "kohls", "macy's", "dillard's", "burlington", "michaels", "savers", "at home", "marshalls", "best buy", "overstock"],
        ["big_box", "specialty_retail", "retail", "grocery"],
    )
    | dict.fromkeys(["kraft", "nestle"], ["food_production", "manufacturing"])
    | dict.fromkeys(["ups", "fedex", "amazon"], ["distribution"])
)
BRAND_EXCLUDE = ["the ups store", "fedex office", "ups access point", "amazon hub", "amazon locker"]
REVIEW_BONUS = {"Google": [(2000, 15), (500, 10), (100, 5)], "Yelp": [(400, 15), (150, 10), (40, 5)]}
FOOTPRINT_BONUS = [(100_000, 15), (40_000, 10), (15_000, 5)]
TIERS = [(60, "A"), (40, "B"), (20, "C"), (0, "D")]
BRAND_POINTS, KEYWORD_POINTS, KEYWORD_MOST, GENERIC_PENALTY, CLOSED_PENALTY, NEEDS_NAME_MOST = 20, 10, 20, 15, 10, 19
NEEDS_NAME_FLAG = "Needs a name: only a building on the map, with no business name, address or phone"

# Fixed value: the words that saved rows are scored with, whatever a search asks for.
DEFAULT_KEYWORDS = ("compactor", "baler", "waste", "recycling")
