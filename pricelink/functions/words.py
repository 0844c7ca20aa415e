"""Fixed values of product names: translations, states, words without meaning, and categories."""

from __future__ import annotations

#: Word -> English word.
TRANSLATIONS = {
    "aceite": "oil",
    "aguacate": "avocado",
    "aluminio": "aluminum",
    "amarilla": "yellow",
    "amarillo": "yellow",
    "arroz": "rice",
    "azucar": "sugar",
    "blanca": "white",
    "blanco": "white",
    "blanqueador": "bleach",
    "bolsa": "bag",
    "camaron": "shrimp",
    "camarones": "shrimp",
    "carne": "meat",
    "cebolla": "onion",
    "cerdo": "pork",
    "champinon": "mushroom",
    "chile": "pepper",
    "costilla": "rib",
    "crudo": "raw",
    "cruda": "raw",
    "desinfectante": "disinfectant",
    "enlatada": "canned",
    "enlatado": "canned",
    "entera": "whole",
    "entero": "whole",
    "espuma": "foam",
    "fresca": "fresh",
    "fresco": "fresh",
    "frijol": "bean",
    "hueso": "bone",
    "huevo": "egg",
    "jalapeno": "jalapeno",
    "leche": "milk",
    "limon": "lime",
    "manteca": "shortening",
    "margarina": "margarine",
    "mezcla": "mix",
    "molida": "ground",
    "muslo": "thigh",
    "papel": "paper",
    "pechuga": "breast",
    "pimiento": "pepper",
    "pollo": "chicken",
    "queso": "cheese",
    "recipiente": "container",
    "res": "beef",
    "rebanada": "sliced",
    "rebanado": "sliced",
    "roja": "red",
    "rojo": "red",
    "sal": "salt",
    "salmuera": "canned",
    "servilleta": "napkin",
    "surtidos": "mixed",
    "tallos": "stem",
    "tapa": "lid",
    "tilapia": "tilapia",
    "tomate": "tomato",
    "tomatillo": "tomatillo",
    "vegetales": "vegetable",
    "verde": "green",
    "vaso": "cup",
    "vaca": "beef",
    "alum": "aluminum",
    "brst": "breast",
    "brgr": "burger",
    "bnsls": "boneless",
    "bnsl": "boneless",
    "chix": "chicken",
    "cmpt": "compartment",
    "cmp": "compartment",
    "comp": "compartment",
    "cont": "container",
    "ctn": "carton",
    "dsp": "dispenser",
    "frsh": "fresh",
    "frzn": "frozen",
    "grnd": "ground",
    "nugg": "nugget",
    "pk": "pack",
    "oz": "ounce",
    "lbs": "pound",
    "lb": "pound",
    "pty": "patty",
    "stk": "steak",
    "wht": "white",
    "ylw": "yellow",
    "xmlt": "melting",
    "ez": "easy",
}

#: Translations that the older scorer does not know.
NOT_IN_LEGACY = [
    "azucar", "costilla", "enlatada", "enlatado", "salmuera", "vaca", "brgr", "bnsls", "bnsl", "cmp", "ctn",
    "dsp", "frzn", "grnd", "pk", "xmlt", "ez",
]

#: Word -> state.
STATES = {"fresh": "fresh", "frozen": "frozen", "canned": "canned", "iqf": "frozen"}

#: States that exclude each other.
CONFLICTS = [("fresh", "canned"), ("fresh", "frozen")]

#: Words without meaning.
GENERIC = [
    "a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "without", "al",
    "con", "de", "del", "el", "en", "la", "las", "los", "o", "para", "por", "sin", "y", "anaquel", "case",
    "caja", "estables", "estable", "grade", "liquida", "liquido", "pack", "ref", "seleccion", "selecto",
    "suelto", "tipo", "unidad", "unidades", "units", "fresh", "frozen", "raw", "whole", "mixed", "special",
]

#: Of these, the ones that the older scorer keeps.
KEPT_IN_LEGACY = ["fresh", "frozen", "raw", "whole", "mixed", "special"]

#: Category -> its words.
CATEGORIES = {
    "beef": ["beef", "ribeye", "burger", "patty", "steak", "chub", "ground", "namp"],
    "pork": ["pork", "ham", "bacon", "rib", "shoulder", "butt"],
    "chicken": ["chicken", "breast", "thigh", "nugget", "wing"],
    "seafood": ["shrimp", "tilapia", "fish", "salmon", "tuna"],
    "produce": ["avocado", "onion", "tomato", "tomatillo", "jalapeno", "cilantro", "pepper", "lime", "mushroom", "vegetable", "bean", "rice"],
    "dairy": ["cheese", "milk", "margarine", "butter", "cream"],
    "paper": ["paper", "napkin", "bag", "towel"],
    "container": ["container", "compartment", "foam", "aluminum", "cup", "lid", "tray"],
    "cleaning": ["bleach", "disinfectant", "soap", "detergent"],
}
