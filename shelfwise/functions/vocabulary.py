"""Vocabulary of the retail domain.

All values here are fixed: category slugs, word lists and taxonomies that results depend on.
"""

# Sources.

#: Stores.
STORES = [
    "fairprice", "shengsiong", "redmart", "coldstorage",
]

#: Base of one store's relative product addresses.
RELATIVE_URL_BASE = "https://shengsiong.com.sg"

#: Category of each store's slug; other slugs are left out.
CATEGORIES = {
    "dairy-chilled-eggs": "Dairy",
    "fruits-vegetables": "Fruits & Vegetables",
    "snacks": "Snacks & Confectionery",
    "sweets-1": "Snacks & Confectionery",
    "chocolates-1": "Snacks & Confectionery",
    "rice-noodles-cooking-ingredients": "Staples",
    "food-cupboard-6": "Staples",
    "dried-fruits--nuts": "Staples",
    "meat-seafood": "Meat & Seafood",
    "drinks": "Beverages",
    "bakery": "Bakery & Breakfast",
    "fruits": "Fruits & Vegetables",
    "vegetables": "Fruits & Vegetables",
    "snacks-confectioneries": "Snacks & Confectionery",
    "rice-noodles-pasta": "Staples",
    "meat-poultry-seafood": "Meat & Seafood",
    "beverages": "Beverages",
    "breakfast-spreads": "Bakery & Breakfast",
    "cooking-baking": "Bakery & Breakfast",
    "snack-and-confectionery": "Snacks & Confectionery",
    "meat": "Meat & Seafood",
    "seafood": "Meat & Seafood",
    "bakery-breakfast": "Bakery & Breakfast",
    "snacks-confectionery": "Snacks & Confectionery",
    "rice-oil-noodles": "Staples",
    "breakfast-bakery": "Bakery & Breakfast",
}

# Packaged goods.

#: Words without meaning for the match.
PACKAGED_STOPWORDS = [
    "the", "and", "with", "for", "plus", "free", "drink", "drinks", "beverage", "beverages", "fresh", "premium", "selection", "pack", "packet",
    "bottle", "bottles", "can", "cans", "carton", "tea", "bags", "bag", "instant", "case", "ctn", "per",
]

#: Packaging by word; the first label that fits counts.
PACKAGED_PACKAGING = {
    "bottle": ["bottle", "bottles", "btl", "pet"],
    "can": ["can", "cans"],
    "carton": ["carton", "cartons", "uht", "box"],
    "packet": ["packet", "packets", "pkt", "packs", "pack"],
    "sachet": ["sachet", "sachets", "sticks", "stick"],
    "tea_bag": ["tea", "teabag", "teabags", "bags", "bag"],
}

#: Phrases of one variant each.
PACKAGED_VARIANTS = [
    ["zero", "zero sugar", "zs"],
    ["original", "orig", "classic"],
    ["less sugar", "reduced sugar", "light"],
    ["unsweetened", "no sugar", "plain"],
    ["chocolate", "cocoa", "malt", "choc"],
    ["vanilla"],
    ["strawberry"],
    ["lychee"],
    ["lemon"],
    ["lime"],
    ["orange"],
    ["grape"],
    ["apple"],
    ["peach"],
    ["mango"],
    ["jasmine"],
    ["green tea"],
    ["oolong"],
    ["houjicha", "roasted tea"],
    ["barley"],
    ["decaf", "decaffeinated"],
    ["hazelnut"],
    ["soy"],
    ["almond"],
    ["oat"],
]

#: Brand names that stand for others.
PACKAGED_BRANDS = {
    "coca cola": "coke",
    "coca-cola": "coke",
    "100 plus": "100plus",
    "fairprice": "fairprice",
    "f&n": "fn",
    "f n": "fn",
    "pokka": "pokka",
    "milo": "milo",
    "nescafe": "nescafe",
    "nestle": "nestle",
    "marigold": "marigold",
    "schweppes": "schweppes",
    "sanitarium": "sanitarium",
}

# Meat and seafood.

#: Words without meaning for the match.
MEAT_STOPWORDS = [
    "the", "and", "with", "for", "plus", "free", "fresh", "premium", "selection", "per", "pack", "packet", "frozen", "chilled", "halal", "organic",
    "reared", "probiotic", "antibiotic", "range", "natural", "marinated", "ready", "cook", "cleaned", "gutted", "iqf", "local", "imported",
    "pesticide", "prepacked", "seedless",
]

#: Packaging by word; the first label that fits counts.
MEAT_PACKAGING = {
    "tray": ["tray", "trays"],
    "bag": ["bag", "bags", "pouch"],
    "vacuum": ["vacuum", "vac"],
    "whole": ["whole"],
    "fillet": ["fillet", "fillets"],
    "slice": ["slice", "slices", "sliced"],
}

#: Phrases of one variant each.
MEAT_VARIANTS = [
    ["frozen", "iqf"],
    ["fresh", "chilled"],
    ["boneless", "bone in", "bone-in"],
    ["skinless", "skin on", "skin-on"],
    ["minced", "mince", "ground"],
    ["sliced", "stir fry", "stir-fry", "shabu shabu"],
    ["cubed", "cube", "diced", "dice"],
    ["whole"],
    ["fillet", "fillets"],
    ["drumstick"],
    ["wing", "winglet", "mid joint"],
    ["breast"],
    ["thigh"],
    ["leg"],
    ["belly"],
    ["collar", "shoulder"],
    ["spare rib", "rib"],
    ["loin"],
    ["ribeye"],
    ["striploin"],
    ["brisket"],
    ["flank"],
    ["prawn", "shrimp"],
    ["salmon"],
    ["squid", "cuttlefish", "sotong"],
    ["scallop"],
    ["pomfret"],
    ["raw"],
    ["cooked"],
    ["australia", "australian", "aus"],
    ["malaysia", "malaysian"],
    ["thailand", "thai"],
    ["japan", "japanese"],
    ["korea", "korean"],
    ["china", "chinese"],
    ["new zealand", "nz"],
]

#: Brand names that stand for others.
MEAT_BRANDS = {
    "farmfresh": "farmfresh",
    "farm fresh": "farmfresh",
    "kee song": "keesong",
    "keesong": "keesong",
    "sakura": "sakura",
    "jean fresh": "jeanfresh",
    "jean": "jeanfresh",
    "aw's market": "awsmarket",
    "aws market": "awsmarket",
    "aw s market": "awsmarket",
    "master grocer": "mastergrocer",
    "hego": "hego",
    "punched foods": "punchedfoods",
    "tegel": "tegel",
    "seara": "seara",
    "perdigao": "perdigao",
    "danpo": "danpo",
    "rose": "rose",
    "cp": "cp",
    "bfg": "bfg",
    "dalee": "dalee",
    "le bao": "lebao",
    "serve by hai sia": "haisia",
    "hai sia": "haisia",
    "catch seafood": "catchseafood",
    "ocean fresh delite": "oceanfreshdelite",
    "pan royal": "panroyal",
    "redmart": "redmart",
    "pasar": "pasar",
    "agro fresh": "agrofresh",
    "yuan zhen yuan": "yuanzhenyuan",
    "zenxin": "zenxin",
    "zespri": "zespri",
    "driscoll's": "driscolls",
    "driscolls": "driscolls",
    "sunkist": "sunkist",
    "sumifru": "sumifru",
    "yayapapaya": "yayapapaya",
    "simply finest": "simplyfinest",
    "chef": "chef",
    "hokto": "hokto",
}

# Fruit and vegetables.

#: Labels of single stores, left out of names.
PRIVATE_LABELS = [
    "pasar", "agro fresh", "agrofresh", "yuan zhen yuan", "yuanzhenyuan", "simply finest", "simplyfinest", "go fresh", "yili farm", "yilafarm",
    "chef", "hydrogreen", "vegeponics", "blush", "thygrace", "sustainir", "sustenir", "freshstory", "kok fah", "churo", "sg local", "sg", "local",
]

#: Origin by word.
ORIGINS = {
    "australia": "australia",
    "australian": "australia",
    "aus": "australia",
    "malaysia": "malaysia",
    "malaysian": "malaysia",
    "thailand": "thailand",
    "thai": "thailand",
    "japan": "japan",
    "japanese": "japan",
    "korea": "korea",
    "korean": "korea",
    "china": "china",
    "chinese": "china",
    "new zealand": "new zealand",
    "nz": "new zealand",
    "india": "india",
    "indian": "india",
    "vietnam": "vietnam",
    "vietnamese": "vietnam",
    "usa": "usa",
    "us": "usa",
    "america": "usa",
    "american": "usa",
    "italy": "italy",
    "italian": "italy",
    "france": "france",
    "french": "france",
    "south africa": "south africa",
    "indonesia": "indonesia",
    "philippines": "philippines",
}

#: Phrases of one qualifier each.
QUALIFIERS = [
    ["organic", "bio"],
    ["baby", "mini", "petit"],
    ["young", "old"],
    ["seedless"],
    ["cherry"],
    ["sweet"],
    ["purple"],
    ["fuji"],
    ["gala", "royal gala"],
    ["pink lady"],
    ["granny smith", "green"],
    ["envy"],
    ["shine muscat", "muscat"],
    ["black"],
    ["red"],
    ["pisang mas"],
    ["gold", "golden"],
    ["ruby red"],
    ["packham"],
    ["fragrant"],
]

#: Types and the words that tell them; the first that fits counts.
PRODUCE_TYPES = {
    "apple": ["apple"],
    "banana": ["banana", "pisang"],
    "grape": ["grape", "muscat"],
    "strawberry": ["strawberry"],
    "blueberry": ["blueberry"],
    "watermelon": ["watermelon"],
    "mango": ["mango"],
    "orange": ["orange", "mandarin", "tangerine"],
    "kiwi": ["kiwi"],
    "pear": ["pear"],
    "avocado": ["avocado"],
    "pineapple": ["pineapple"],
    "papaya": ["papaya"],
    "coconut": ["coconut"],
    "dragonfruit": ["dragonfruit", "dragon fruit"],
    "guava": ["guava"],
    "longan": ["longan"],
    "lemon": ["lemon"],
    "lime": ["lime"],
    "peach": ["peach", "nectarine"],
    "plum": ["plum"],
    "fig": ["fig"],
    "date": ["date", "dates"],
    "broccoli": ["broccoli", "broccolini"],
    "cauliflower": ["cauliflower"],
    "carrot": ["carrot"],
    "cabbage": ["cabbage", "wong bok", "wongbok"],
    "spinach": ["spinach", "puay leng"],
    "xiao bai cai": ["xiao bai cai", "bok choy", "siew pak choy", "nai bai"],
    "kailan": ["kailan", "kai lan"],
    "chye sim": ["chye sim", "cai xin", "choy sum", "cai sim"],
    "long bean": ["long bean"],
    "lady finger": ["lady finger", "ladies finger", "okra"],
    "cucumber": ["cucumber"],
    "tomato": ["tomato"],
    "onion": ["onion"],
    "garlic": ["garlic"],
    "ginger": ["ginger"],
    "potato": ["potato"],
    "sweet potato": ["sweet potato"],
    "mushroom": ["mushroom", "shiitake", "enoki", "shimeji", "oyster mushroom", "king oyster"],
    "corn": ["corn", "sweet corn", "baby corn"],
    "capsicum": ["capsicum", "bell pepper"],
    "pumpkin": ["pumpkin", "butternut"],
    "kang kong": ["kang kong"],
    "bittergourd": ["bitter gourd", "bittergourd"],
    "spring onion": ["spring onion", "scallion"],
    "celery": ["celery"],
    "asparagus": ["asparagus"],
    "zucchini": ["zucchini"],
    "brinjal": ["brinjal", "eggplant"],
    "leek": ["leek"],
    "pea": ["pea", "snow pea", "pea sprout", "edamame"],
    "bean sprout": ["bean sprout"],
    "radish": ["radish", "daikon"],
    "beetroot": ["beetroot", "beet"],
    "lettuce": ["lettuce", "romaine", "butterhead", "iceberg"],
    "kale": ["kale"],
    "yam": ["yam", "nagaimo"],
    "lemongrass": ["lemon grass", "lemongrass"],
    "chilli": ["chilli", "chili", "chilli padi"],
}

# Commodities.

#: Cuts and the parts of names that tell them, in the order of trial.
MEAT_CUTS = {
    "chicken - whole": ["whole chicken", "chicken griller", "spring chicken", "half chicken", "chicken half"],
    "chicken - breast": ["chicken breast", "breast boneless", "breast fillet", "breast skinless", "boneless breast", "boneless skinless breast"],
    "chicken - leg": ["chicken leg", "boneless leg", "leg boneless", "leg quarter", "whole leg", "chicken boneless leg"],
    "chicken - thigh": ["chicken thigh", "thigh boneless", "thigh skinless", "thigh cube"],
    "chicken - drumstick": ["drumstick"],
    "chicken - wing": ["mid joint wing", "wing stick", "drumette", "winglet", "chicken wing", "3 joint wing"],
    "chicken - fillet": ["chicken fillet", "chicken tenderloin"],
    "chicken - mince": ["minced chicken", "chicken mince"],
    "chicken - feet": ["chicken feet"],
    "chicken - bones": ["chicken bone", "chicken bones"],
    "pork - belly": ["pork belly", "三层肉", "三层肉片", "belly slices", "belly chunk", "belly cubes"],
    "pork - collar/shoulder": ["pork collar", "pork shoulder", "twee bak", "五花肉", "collar steak", "collar slices", "collar cubes", "collar minced"],
    "pork - spare rib": ["spare rib", "big spare rib", "prime rib", "小排", "子弹排"],
    "pork - loin": ["pork loin", "pork chop", "loin chop", "loin boneless", "loin bone"],
    "pork - fillet": ["pork fillet", "pork tenderloin", "腰肉"],
    "pork - mince": ["minced pork", "pork mince", "肉碎"],
    "pork - soft bone": ["soft bone", "软骨"],
    "pork - soup bone": ["soup bone", "big bone", "汤骨"],
    "pork - trotter": ["pork trotter", "trotter"],
    "beef - ribeye": ["beef ribeye", "ribeye steak", "rib eye"],
    "beef - striploin": ["beef striploin", "striploin steak", "strip loin"],
    "beef - mince": ["minced beef", "beef mince", "mince beef"],
    "beef - brisket": ["beef brisket", "brisket flat"],
    "beef - flank": ["beef flank", "flank steak", "flank stir fry"],
    "beef - chuck": ["beef chuck", "chuck tender", "chuck roll"],
    "beef - tenderloin": ["beef tenderloin"],
    "beef - oxtail": ["beef oxtail", "oxtail"],
    "beef - short rib": ["beef short rib", "short ribs", "galbi"],
    "lamb - rack": ["lamb rack", "lamb cutlet", "frenched lamb"],
    "lamb - diced": ["lamb diced", "lamb cube"],
    "seafood - salmon": ["salmon fillet", "salmon portion", "salmon belly", "salmon steak", "salmon chunk", "三文鱼", "salmon head"],
    "seafood - prawn": ["tiger prawn", "vannamei prawn", "vannamei shrimp", "shrimp meat", "prawn meat", "peeled prawn", "glass prawn", "banana prawn"],
    "seafood - squid": ["squid ring", "squid tube", "squid flower", "sotong", "鱿鱼", "苏东", "cuttlefish"],
    "seafood - scallop": ["hokkaido scallop", "sea scallop", "bay scallop", "boiled scallop", "half shell scallop"],
    "seafood - clam": ["clam meat", "flower clam", "white clam", "venus clam", "shortnecked clam"],
    "seafood - mussel": ["mussel meat", "whole shell mussel", "half shell mussel"],
    "seafood - pomfret": ["golden pomfret", "black pomfret", "chinese pomfret", "white pomfret", "白鲳", "黑鲳", "金鲳"],
    "seafood - threadfin": ["threadfin", "午鱼", "balai threadfin"],
    "seafood - batang/mackerel": ["batang", "spanish mackerel", "巴东", "saba fish", "saba mackerel"],
    "seafood - snapper": ["red snapper", "white snapper", "ang go li", "红鸡"],
    "seafood - seabass/barramundi": ["seabass", "barramundi", "asian seabass"],
    "seafood - stingray": ["stingray", "方鱼"],
    "seafood - dory/sutchi": ["dory", "sutchi fillet", "sutchi cube", "多利鱼"],
    "seafood - oyster": ["oyster meat", "生蚝"],
}

#: Tried after the meats.
PRODUCE_CUTS = {
    "fruit - apple": ["apple", "fuji apple", "gala apple", "pink lady", "granny smith"],
    "fruit - banana": ["banana", "pisang mas"],
    "fruit - grape": ["grape", "seedless grape", "shine muscat", "muscat"],
    "fruit - strawberry": ["strawberry"],
    "fruit - blueberry": ["blueberry"],
    "fruit - watermelon": ["watermelon"],
    "fruit - mango": ["mango"],
    "fruit - orange": ["orange", "cara cara", "mandarin orange", "mandarin"],
    "fruit - kiwi": ["kiwi"],
    "fruit - pear": ["pear", "packham pear", "fragrant pear", "bing tang pear"],
    "fruit - avocado": ["avocado"],
    "fruit - pineapple": ["pineapple"],
    "fruit - papaya": ["papaya"],
    "fruit - coconut": ["coconut"],
    "fruit - dragonfruit": ["dragonfruit", "dragon fruit"],
    "fruit - guava": ["guava", "seedless guava"],
    "fruit - longan": ["longan"],
    "fruit - durian": ["durian"],
    "veg - broccoli": ["broccoli", "broccolini"],
    "veg - cauliflower": ["cauliflower"],
    "veg - carrot": ["carrot"],
    "veg - cabbage": ["cabbage", "beijing cabbage", "wong bok", "wongbok", "round cabbage", "purple cabbage"],
    "veg - spinach": ["spinach", "puay leng", "round spinach", "red spinach", "sharp spinach"],
    "veg - xiao bai cai": ["xiao bai cai", "bok choy", "siew pak choy", "nai bai", "baby bok choy"],
    "veg - kailan": ["kailan", "kai lan", "baby kailan", "baby kai lan"],
    "veg - chye sim": ["chye sim", "cai xin", "cai sim", "choy sum"],
    "veg - long bean": ["long bean"],
    "veg - lady finger": ["lady finger", "ladies finger", "okra"],
    "veg - cucumber": ["cucumber", "japanese cucumber", "old cucumber", "local cucumber"],
    "veg - tomato": ["tomato", "cherry tomato"],
    "veg - onion": ["yellow onion", "red onion", "white onion", "small onion", "shallot"],
    "veg - garlic": ["garlic"],
    "veg - ginger": ["old ginger", "young ginger", "ginger"],
    "veg - potato": ["potato", "sweet potato", "purple sweet potato", "baby potato"],
    "veg - mushroom": ["shiitake mushroom", "enoki mushroom", "shimeji mushroom", "oyster mushroom", "king oyster", "button mushroom", "mushroom"],
    "veg - corn": ["sweet corn", "corn", "baby corn"],
    "veg - capsicum": ["capsicum", "bell pepper"],
    "veg - pumpkin": ["pumpkin", "butternut"],
    "veg - kang kong": ["kang kong"],
    "veg - bittergourd": ["bitter gourd", "bittergourd"],
    "veg - spring onion": ["spring onion", "scallion"],
    "veg - celery": ["celery"],
    "veg - asparagus": ["asparagus"],
    "veg - zucchini": ["zucchini"],
    "veg - chilli": ["chilli padi", "red chilli", "green chilli"],
}

#: Parts of names that tell frozen goods.
FROZEN_WORDS = [
    "frozen", "iqf", "冻", "冷冻",
]
