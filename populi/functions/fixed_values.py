"""Names, lists and numbers that results depend on, given as plain text."""

# fixed values: source category to one of the seven main categories
MAIN_CATEGORIES = {
    "Appliances": ["Appliances", "All Electronics", "Amazon Home", "Automotive", "Camera & Photo", "Car Electronics",
                   "Cell Phones & Accessories", "Tools & Home Improvement", "Industrial & Scientific",
                   "Office Products"],
    "All Beauty": ["All Beauty", "Premium Beauty"],
    "Digital Music": ["Digital Music", "Musical Instruments", "Home Audio & Theater", "Portable Audio & Accessories"],
    "Video Games": ["Video Games", "Movies & TV", "Toys & Games"],
    "Health & Personal Care": ["Health & Personal Care", "Baby", "Grocery", "Sports & Outdoors"],
    "Software": ["Software", "Appstore for Android", "Computers", "Buy a Kindle"],
    "Clothing Shoes & Jewelry": ["AMAZON FASHION", "Arts, Crafts & Sewing", "Books"],
}

# fixed values: main categories that have a code spelling; any other main category keeps its name
MAIN_CATEGORY_CODES = {
    "Fashion": "Clothing_Shoes_and_Jewelry",
    "All Beauty": "All_Beauty",
    "Digital Music": "Digital_Music",
    "Video Games": "Video_Games",
    "Health & Personal Care": "Health_and_Personal_Care",
    "Appliances": "Appliances",
    "Software": "Software",
}

# fixed values: the baselines' own grouping
BASELINE_CATEGORIES = {
    "All Beauty": ["All Beauty", "Premium Beauty"],
    "Health & Personal Care": ["Health & Personal Care", "Baby", "Grocery", "Pet Supplies", "Sports & Outdoors"],
    "Video Games": ["Video Games", "Toys & Games", "Computers", "Software", "Movies & TV"],
    "Appliances": ["All Electronics", "Cell Phones & Accessories", "Camera & Photo", "Office Products",
                   "Tools & Home Improvement", "Industrial & Scientific", "Appliances", "Amazon Home", "Automotive"],
    "Digital Music": ["Digital Music", "Musical Instruments", "Home Audio & Theater", "Portable Audio & Accessories",
                      "Amazon Devices"],
    "Software": ["Appstore for Android", "Buy a Kindle"],
    "Fashion": ["Books", "AMAZON FASHION", "Arts, Crafts & Sewing"],
}

# fixed values: keyword rules, tried in order; a rule holds when any keyword occurs in the lower-cased name
KEYWORD_RULES = {
    "sampling": [
        ("Clothing_Shoes_and_Jewelry", ["fashion", "clothing", "shoes", "jewelry", "apparel"]),
        ("Appliances", ["appliance", "home improvement", "amazon home", "industrial & scientific"]),
        ("All_Beauty", ["beauty", "cosmetic", "makeup", "skincare"]),
        ("Digital_Music", ["music", "portable audio", "home audio", "car electronics"]),
        ("Video_Games", ["gaming", "game"]),
        ("Health_and_Personal_Care", ["health", "personal care", "wellness", "baby", "grocery"]),
        ("Software", ["software", "appstore", "app store", "application", "computers", "all electronics",
                      "cell phones", "camera", "photo", "office products", "books", "kindle", "movies", "tv"]),
        ("Appliances", ["sports", "outdoors", "automotive", "arts", "crafts", "sewing"]),
    ],
    "topics": [
        ("Clothing_Shoes_and_Jewelry", ["fashion", "clothing", "shoes", "jewelry", "apparel"]),
        ("Appliances", ["appliance", "tools & home improvement", "amazon home", "industrial & scientific",
                        "sports & outdoors", "automotive", "arts, crafts & sewing"]),
        ("All_Beauty", ["beauty", "cosmetic", "makeup", "skincare"]),
        ("Digital_Music", ["music", "audio", "car electronics"]),
        ("Video_Games", ["gaming", "game"]),
        ("Health_and_Personal_Care", ["health", "personal care", "wellness", "baby", "grocery"]),
        ("Software", ["software", "app", "computers", "all electronics", "cell phones & accessories",
                      "camera & photo", "office products", "buy a kindle", "books", "movies & tv"]),
    ],
}

# fixed values: words read as a sentiment; anything else is Neutral
SENTIMENT_WORDS = {
    "Positive": ["positive", "pos", "good", "great", "excellent", "happy", "satisfied"],
    "Negative": ["negative", "neg", "bad", "poor", "terrible", "unhappy", "dissatisfied"],
    "Neutral": ["neutral", "neut", "mixed", "ambivalent", "ok", "okay", "average"],
}

# fixed values: words ignored when theme names are compared word by word
THEME_STOP_WORDS = ["and", "or", "the", "a", "an", "of", "for", "in", "on", "at", "to", "with"]

# fixed values: tokens that only carry JSON structure
STRUCTURE_TOKENS = ['"', "{", "}", "[", "]", ":", ","]

# fixed values: USD per million tokens as (input, cached input, output)
MODEL_PRICES = {
    "o3": (2.00, 0.50, 8.00),
    "gpt-5.2": (1.75, 0.175, 14.00),
    "gpt-4o": (2.50, 1.25, 10.00),
    "gpt-4o-mini": (0.15, 0.075, 0.60),
    "gpt-5-mini": (0.15, 0.075, 0.60),
}

# fixed values: limits and weights
TEXT_WEIGHT, THEME_WEIGHT = 0.7, 0.3
SAME_DELTA = 0.001
