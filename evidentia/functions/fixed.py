"""Word lists, patterns, tables and thresholds that decide results. They are data, not logic."""

from __future__ import annotations

# --- Fixed values: pages and URLs -------------------------------------------------------------------------------

PRIORITY_PATHS = """
/contact /over-ons /about /about-us /voorwaarden /algemene-voorwaarden /terms /tc/ /privacy /privacybeleid
/retour /return /retourneren /klantenservice /customer-service /impressum /disclaimer /bedrijfsgegevens
/betaal /betalings /betaalmethod /payment /verzend /shipping /levering /delivery /over /info /wie-zijn
/faq /help /service /sitemap /bankgegeven /rekeningnummer
""".split()

PRODUCT_URLS = r"""
/product[s]?/
/producten/
/artikel[en]?/
/item[s]?/
/collections?/.+/.+
/shop/[^/]+-\d{4,}
/p/[a-z0-9\-]{5,}
/[a-z0-9\-]+-\d{6,}
[?&](product|item|id)=\d+
""".split()

PAGE_TYPES = {
    "contact": ["/contact", "/klantenservice", "/customer-service", "/bedrijfsgegevens"],
    "terms": ["/voorwaarden", "/algemene-voorwaarden", "/terms", "/tc/"],
    "privacy": ["/privacy", "/privacybeleid", "/privacy-policy"],
    "return": ["/retour", "/return", "/ruil", "/retourneren"],
}

SKIPPED_EXTENSIONS = "pdf jpg jpeg png gif svg webp css js zip rar doc docx xls xlsx mp3 mp4 avi mov woff woff2 ttf eot ico".split()

TRACKING_PARAMETERS = "utm_source utm_medium utm_campaign utm_content utm_term fbclid gclid".split()

SOCIAL_DOMAINS = {
    "facebook.com": "facebook", "fb.com": "facebook", "instagram.com": "instagram", "twitter.com": "twitter",
    "x.com": "twitter", "linkedin.com": "linkedin", "youtube.com": "youtube", "tiktok.com": "tiktok",
    "pinterest.com": "pinterest", "trustpilot.com": "trustpilot",
}

BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "169.254.169.254"]
PRIVATE_NETWORKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fc00::/7"]

URL_COLUMN_NAMES = ["url", "website", "link", "webshop"]

# --- Fixed values: entities in text -------------------------------------------------------------------------------

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
EMAIL_ASSETS = r"\.(png|jpg|jpeg|gif|svg|webp|css|js|woff|ttf|eot)$"
MAILTO = r"""mailto:([^"'?\s]+)"""

PHONES = [
    r"(?<!\d)(?:\+31|0031)[\s\-.]?[1-9](?:[\s\-.]?\d){8}(?!\d)",
    r"(?<!\d)0[1-9](?:[\s\-.]?\d){8}(?!\d)",
    r"(?<!\d)0[1-9]\d[\s\-.]?\d{3}[\s\-.]?\d{4}(?!\d)",
    r"(?<!\d)\+\d{1,3}[\s\-.]?\d[\s\-.]?(?:\d[\s\-.]?){7,12}(?!\d)",
]

KVK_NUMBERS = [
    r"(?i)(?:kvk|kamer\s*van\s*koophandel|handelsregister)[\s:\-\.]*(?:nummer|nr|no)?[\s:\-\.]*(\d{8})\b",
    r"(?i)(?:CoC|Chamber\s*of\s*Commerce)[\s:\-#\.]*(\d{8})\b",
    r"(?i)(?:kvk|kamer van koophandel|handelsregister|coc).{0,30}?(\d{8})\b",
    r"(?i)(?:registratie|registration)[\s\-]*(?:nummer|number|nr)[\s:\-\.]*(\d{8})\b",
]

VAT_NUMBERS = [r"(?i)(?:btw|vat|omzetbelasting)[\s:\-]*(NL\d{9}B\d{2})", r"(\bNL\d{9}B\d{2}\b)"]

IBAN = r"\b[A-Z]{2}\d{2}[\s]?[A-Z]{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{2,4}\b"

STREET_ADDRESS = (
    r"([A-Z][a-zéèëïöüá]+(?:\s[a-z]+)*(?:straat|weg|laan|plein|gracht|kade|singel|dijk|pad|dreef|hof|markt|ring|steeg|burcht|park))"
    r"\s+(\d{1,5}(?:\s?[a-zA-Z]{1,3})?)(?:[,\s]+(\d{4}\s?[A-Z]{2}))?(?:[,\s]+([A-Z][a-z]+(?:\s[A-Z]?[a-z]+)*))?"
)
CONTEXT_ADDRESS = r"([\w\.\-]+\s+\d{1,5}[\w]?[,\s]+\d{4}\s?[A-Z]{2}(?:[,\s]+[A-Z][\w\s]{2,30})?)"

PRICE = r"[€$£]\s*(\d{1,4}(?:[.,]\d{2})?)\b"
SUSPICIOUS_PRICE = 3.0

OPENING_SOON = [
    "binnenkort geopend", "binnenkort beschikbaar", "binnenkort online", "binnenkort open", "nog even geduld", "lancering",
    "coming soon", "opening soon", "launching soon", "under construction", "launch soon",
    "demnächst", "bald verfügbar", "in kürze", "bientôt", "prochainement", "ouverture prochaine",
    "próximamente", "em breve", "prossimamente",
]
MAINTENANCE = [
    "in onderhoud", "tijdelijk offline", "onderhoudswerkzaamheden", "tijdelijk niet beschikbaar", "gepland onderhoud", "wij zijn tijdelijk",
    "under maintenance", "down for maintenance", "maintenance mode", "temporarily unavailable", "we'll be back", "be back soon", "site is down",
    "wartungsarbeiten", "wir arbeiten daran", "vorübergehend nicht", "en maintenance", "en cours de maintenance", "temporairement indisponible",
]
DELIVERY_TIME = [
    "levertijd", "bezorgtijd", "verzendtijd", "werkdag", "werkdagen", "bezorgd binnen", "levert binnen", "verwachte levering", "verzending binnen",
    "delivery time", "shipping time", "business day", "ships within", "dispatched within", "delivered within", "estimated delivery", "delivery within",
    "lieferzeit", "werktage", "lieferung innerhalb", "délai de livraison", "jours ouvrables", "livraison sous", "plazo de entrega", "días hábiles",
]
PRE_ORDER = [
    "voorbestelling", "pre-order", "pre-bestellen", "vooraf bestellen", "preorder", "pre-sale", "presale", "pre order",
    "vorbestellung", "vorbestellen", "précommande", "pré-commande", "pre-pedido", "preventa",
]
WHATSAPP = ["wa.me/", "whatsapp"]

# --- Fixed values: technology signatures (category, name, patterns in the page, response headers) -------------------

TECHNOLOGIES = [
    ("ecommerce", "Shopify", [r"cdn\.shopify\.com", r"Shopify\.theme", r"shopify-section", r"myshopify\.com", r"shopify_analytics"], ["x-shopify"]),
    ("ecommerce", "WooCommerce", [r"woocommerce", r"wc-block", r"wp-content/plugins/woocommerce", r"wc_add_to_cart", r"wc-cart"], []),
    ("ecommerce", "Magento", [r"mage/cookies", r"Magento_Ui", r"magento", r"/static/version", r"mage-init", r"data-mage-init"], ["x-magento"]),
    ("ecommerce", "PrestaShop", [r"prestashop", r"/modules/ps_", r"prestashop\.js"], []),
    ("ecommerce", "OpenCart", [r"opencart", r"catalog/view/theme", r"route=product"], []),
    ("ecommerce", "BigCommerce", [r"bigcommerce\.com", r"cdn\.bcapp", r"stencil-utils"], []),
    ("ecommerce", "Lightspeed", [r"lightspeed", r"seoshop\.net", r"shoplightspeed", r"api\.webshopapp\.com"], []),
    ("ecommerce", "CCV Shop", [r"ccvshop", r"ccv\.eu"], []),
    ("ecommerce", "Mijnwebwinkel", [r"mijnwebwinkel", r"mijndomein\.nl"], []),
    ("cms", "WordPress", [r"wp-content", r"wp-includes", r"wp-json", r'name="generator"\s+content="WordPress'], []),
    ("cms", "Joomla", [r"/media/jui/", r"joomla", r'content="Joomla'], []),
    ("cms", "Drupal", [r"drupal\.js", r"Drupal\.settings", r"/sites/default/files"], ["x-drupal"]),
    ("cms", "Wix", [r"wix\.com", r"wixstatic\.com", r"X-Wix"], []),
    ("cms", "Squarespace", [r"squarespace", r"sqsp\.net"], []),
    ("payment", "Mollie", [r"mollie\.com", r"mollie", r"js\.mollie\.com"], []),
    ("payment", "Stripe", [r"js\.stripe\.com", r"stripe\.com", r"Stripe\("], []),
    ("payment", "Adyen", [r"adyen\.com", r"checkoutshopper.*adyen"], []),
    ("payment", "PayPal", [r"paypal\.com", r"paypal\.com/sdk", r"paypalobjects\.com"], []),
    ("payment", "iDEAL", [r"ideal"], []),
    ("payment", "Klarna", [r"klarna\.com", r"klarna"], []),
    ("payment", "MultiSafepay", [r"multisafepay"], []),
    ("payment", "Buckaroo", [r"buckaroo"], []),
    ("analytics", "Google Analytics", [r"google-analytics\.com", r"googletagmanager\.com", r"gtag\(", r"ga\('create'", r"UA-\d{4,}-\d{1,}", r"G-[A-Z0-9]{10,12}(?![a-z])"], []),
    ("analytics", "Meta Pixel", [r"connect\.facebook\.net", r"fbevents\.js", r"fbq\("], []),
    ("analytics", "Hotjar", [r"hotjar\.com", r"static\.hotjar\.com"], []),
    ("analytics", "Google Tag Manager", [r"googletagmanager\.com/gtm", r"GTM-[A-Z0-9]+"], []),
    ("privacy", "Cookiebot", [r"cookiebot\.com", r"CookieConsent"], []),
    ("privacy", "OneTrust", [r"onetrust\.com", r"optanon"], []),
    ("privacy", "CookieYes", [r"cookieyes\.com"], []),
    ("privacy", "Complianz", [r"complianz", r"cmplz"], []),
    ("hosting", "Cloudflare", [r"cloudflare"], ["cf-ray", "cf-cache-status"]),
    ("hosting", "Amazon CloudFront", [r"cloudfront\.net"], ["x-amz-cf"]),
    ("hosting", "Vercel", [r"vercel"], ["x-vercel"]),
    ("hosting", "Netlify", [r"netlify"], ["x-nf"]),
    ("framework", "React", [r"react\.production\.min\.js", r"__NEXT_DATA__", r"react-dom", r"_react", r"reactDOM"], []),
    ("framework", "Vue.js", [r"vue\.js", r"vue\.min\.js", r"vue\.runtime", r"__vue__", r"data-v-[a-f0-9]"], []),
    ("framework", "jQuery", [r"jquery\.min\.js", r"jquery-\d", r"jQuery\("], []),
    ("framework", "Next.js", [r"__NEXT_DATA__", r"_next/static"], []),
    ("framework", "Nuxt.js", [r"__NUXT__", r"_nuxt/"], []),
    ("security", "reCAPTCHA", [r"recaptcha", r"google\.com/recaptcha"], []),
    ("security", "hCaptcha", [r"hcaptcha\.com"], []),
    ("trustmark", "Thuiswinkel Waarborg", [r"thuiswinkel\.org", r"thuiswinkelwaarborg", r"thuiswinkel"], []),
    ("trustmark", "WebwinkelKeur", [r"webwinkelkeur\.nl", r"webwinkelkeur"], []),
    ("trustmark", "Trusted Shops", [r"trustedshops\.com", r"trusted-shops"], []),
    ("trustmark", "Kiyoh", [r"kiyoh\.com", r"kiyoh\.nl"], []),
    ("trustmark", "Trustpilot", [r"trustpilot\.com", r"trustpilot"], []),
]

SHOPIFY_IDENTITIES = {
    "shop_id": r'"shopId"\s*:\s*(\d+)',
    "myshopify_domain": r'"myshopify_domain"\s*:\s*"([^"]+)"',
    "shopify_shop": r'Shopify\.shop\s*=\s*"([^"]+)"',
    "permanent_domain": r'"permanent_domain"\s*:\s*"([^"]+)"',
    "storefront_token": r'"storefrontAccessToken"\s*:\s*"([^"]+)"',
}

# --- Fixed values: tracker platforms (key, name, prefix of shown ids, patterns) ---------------------------------------

TRACKERS = [
    ("google_ads", "Google Ads", "AW-", [r"(?i)AW-(\d{9,11})", r"""(?i)google_conversion_id\s*[=:]\s*["']?(\d{9,11})""", r"""(?i)send_to["']?\s*[:=]\s*["']?AW-(\d{9,11})"""]),
    ("google_analytics", "Google Analytics", "", [r"(?i)(UA-\d{4,10}-\d{1,4})", r"(G-[A-Z0-9]{10,12})(?![a-z])"]),
    ("google_tag_manager", "Google Tag Manager", "", [r"(?i)(GTM-[A-Z0-9]{5,8})"]),
    ("meta_pixel", "Meta/Facebook Pixel", "FB-", [r"""(?i)fbq\s*\(\s*['"]init['"]\s*,\s*['"](\d{12,20})['"]""", r"(?i)facebook\.com/tr\?id=(\d{12,20})", r"""(?i)content["']?\s*[:=]\s*["'](\d{15,16})["']"""]),
    ("tiktok_pixel", "TikTok Pixel", "TT-", [r"""(?i)ttq\.load\s*\(\s*['"]([A-Z0-9]{10,25})['"]""", r"""(?i)analytics\.tiktok\.com.*["']([A-Z0-9]{10,25})["']"""]),
    ("bing_uet", "Microsoft/Bing Ads", "UET-", [r"""(?i)uetq.*["'](\d{7,10})["']""", r"(?i)bat\.bing\.com/bat\.js\?.*ti=(\d{7,10})", r"""(?i)UET\s*tag\s*ID["\s:=]*(\d{7,10})"""]),
]

# --- Fixed values: network evidence -----------------------------------------------------------------------------------

SECURITY_HEADERS = {
    "Strict-Transport-Security": True, "Content-Security-Policy": True, "X-Frame-Options": False, "X-Content-Type-Options": False,
    "X-XSS-Protection": False, "Referrer-Policy": False, "Permissions-Policy": False, "Cross-Origin-Opener-Policy": False,
    "Cross-Origin-Resource-Policy": False,
}

#: Field -> line labels, the first that occurs wins.
WHOIS_LABELS = {
    "registrar": ["registrar", "registrar name", "sponsoring registrar", "registration service provider"],
    "creation_date": ["creation date", "created", "created date", "registered", "registration time", "domain registered", "created on"],
    "expiration_date": ["expir(?:y|ation|es) date", "registry expiry date", "paid-till", "expiry", "expire date", "domain expiration"],
    "country": ["registrant country", "country"],
}

PRIVACY_WORDS = [
    "privacy", "proxy", "redacted", "whoisguard", "domains by proxy", "contact privacy", "withheld", "gdpr", "data protected",
    "whois privacy", "perfect privacy", "identity protect", "not disclosed", "statutory masking", "domain protection",
]

FREE_ISSUERS = ["let's encrypt", "zerossl", "buypass", "ssl.com"]
NO_RESULTS = ["geen resultaten", "niets gevonden", "no results", "0 resultaten"]

# --- Fixed values: risk rules (key, label, points when true, deduction when false, tip) ----------------------------------

RISK_RULES = [
    ("has_address", "Fysiek adres gevonden", 15, 15, "Geen adres op de website gevonden."),
    ("has_email", "E-mailadres gevonden", 10, 10, "Geen e-mailadres op de website gevonden."),
    ("has_phone", "Telefoonnummer gevonden", 5, 0, "Geen telefoonnummer gevonden."),
    ("has_kvk", "KvK-nummer gevonden", 15, 10, "Geen KvK-nummer op de website gevonden."),
    ("has_btw", "BTW-nummer gevonden", 5, 0, "Geen BTW-nummer gevonden."),
    ("kvk_verified", "KvK geverifieerd in register", 10, 5, "KvK-nummer niet verifieerbaar in het register."),
    ("has_contact_page", "Contactpagina aanwezig", 5, 5, "Geen contactpagina gevonden."),
    ("has_privacy", "Privacyverklaring aanwezig", 5, 3, "Geen privacyverklaring gevonden."),
    ("has_terms", "Algemene voorwaarden aanwezig", 5, 3, "Geen algemene voorwaarden gevonden."),
    ("has_returns", "Retourbeleid aanwezig", 5, 3, "Geen retourbeleid gevonden."),
    ("has_nl_iban", "Nederlandse bankrekening (NL IBAN)", 10, 5, "Geen Nederlandse bankrekening gevonden."),
    ("no_foreign_iban", "Geen buitenlandse bankrekening", 0, 20, "Buitenlandse bankrekening gevonden — verhoogd risico voor NL webwinkel."),
    ("has_ssl", "Geldig SSL-certificaat", 5, 10, "Geen geldig SSL-certificaat."),
    ("domain_age_1yr", "Domein ouder dan 1 jaar", 5, 5, "Domein is jonger dan 1 jaar — verhoogd risico."),
    ("domain_age_2yr", "Domein ouder dan 2 jaar", 5, 0, "Domein is jonger dan 2 jaar."),
    ("has_verified_tm", "Geverifieerd keurmerk aanwezig", 5, 0, "Geen geverifieerd keurmerk gevonden."),
    ("no_fake_tm", "Geen vals keurmerk", 10, 20, "Vals of niet-geverifieerd keurmerk gevonden — sterke rode vlag."),
    ("not_in_scam_db", "Niet in fraudedatabase", 0, 40, "Domein gevonden in fraudedatabase (opgelicht.nl / fraudehelpdesk.nl / watchlistinternet.nl) — kritiek risico."),
]
RISK_THRESHOLDS = {"low": 70, "medium": 40, "high": 15}
RISK_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "unknown": 4}

COLLECTORS = "whois ssl scrape kvk dns_http tech trustmark ad_tracker scam_check bag_validation".split()

LANGUAGE_NAMES = {"nl": "Nederlands", "en": "Engels", "de": "Duits", "fr": "Frans", "es": "Spaans", "it": "Italiaans", "pt": "Portugees", "pl": "Pools", "zh": "Chinees"}

COUNTRY_NAMES = {
    "NL": "Nederland", "DE": "Duitsland", "BE": "België", "GB": "Verenigd Koninkrijk", "FR": "Frankrijk", "ES": "Spanje", "IT": "Italië", "PT": "Portugal",
    "AT": "Oostenrijk", "CH": "Zwitserland", "PL": "Polen", "CZ": "Tsjechië", "DK": "Denemarken", "SE": "Zweden", "NO": "Noorwegen", "FI": "Finland",
    "IE": "Ierland", "LU": "Luxemburg", "RO": "Roemenië", "BG": "Bulgarije", "HR": "Kroatië", "HU": "Hongarije", "SK": "Slowakije", "SI": "Slovenië",
    "LT": "Litouwen", "LV": "Letland", "EE": "Estland", "MT": "Malta", "CY": "Cyprus", "GR": "Griekenland", "TR": "Turkije", "US": "VS",
    "RU": "Rusland", "UA": "Oekraïne", "CN": "China",
}

# --- Fixed values: sites that say nothing about a shop when they turn up in a search -----------------------------------

SKIPPED_SITES = [
    "duckduckgo.com", "google.com", "facebook.com", "github.com", "stackoverflow.com", "w3schools.com", "developer.mozilla.org",
    "support.google.com", "ads.google.com", "business.facebook.com",
]

#: Hosts that say nothing of an id's owner, by platform.
SKIPPED_OWNERS = {"google_ads": ["duckduckgo.com", "google.com"], "meta": ["duckduckgo.com", "facebook.com", "google.com"]}

#: Fraud lists, and whether a page's own words that nothing was found count against its mentions.
FRAUD_SOURCES = {"opgelicht": True, "fraudehelpdesk": True, "watchlist": False}
