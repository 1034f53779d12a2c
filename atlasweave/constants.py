"""Fixed values the results depend on: word lists, lookup tables, limits and message texts.

Everything here is data, kept in its natural order because several lists are
priority lists ("first match wins").
"""

# --- URL handling: fixed values -------------------------------------------------------------
TRACKING_KEYS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader",
    "utm_name", "gclid", "gbraid", "wbraid", "dclid", "fbclid", "msclkid", "mc_cid", "mc_eid",
    "igshid", "ttclid", "twclid", "yclid", "_ga", "_gl", "ref_src", "ref_url", "spm", "scm",
    "from_source", "wpmp_switcher", "hsa_acc", "hsa_cam", "hsa_grp", "hsa_ad",
]
CACHE_BUSTER_KEYS = ["v", "ver", "version", "rev", "cb", "_", "ts", "timestamp", "nocache"]
RESIZE_KEYS = [
    "w", "h", "width", "height", "size", "resize", "fit", "q", "quality", "dpr", "format", "fm",
    "auto", "crop",
]
IMAGE_EXTENSIONS = [
    "jpg", "jpeg", "png", "webp", "gif", "svg", "avif", "bmp", "ico", "tif", "tiff", "jfif", "apng",
    "heic", "heif",
]
GEO_EXTENSIONS = ["kml", "kmz", "geojson", "gpx", "gml", "topojson"]
NON_PAGE_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "webp", "svg", "avif", "bmp", "ico", "tif", "tiff", "heic",
    "pdf", "zip", "rar", "7z", "gz", "tar", "bz2", "dmg", "exe", "msi", "apk",
    "mp3", "mp4", "avi", "mov", "wmv", "webm", "ogg", "wav", "flac", "m4a", "mkv",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv", "rtf",
    "css", "js", "mjs", "json", "xml", "rss", "atom", "woff", "woff2", "ttf", "eot", "map",
    "kml", "kmz", "geojson", "gpx", "gml", "topojson",
]
SECOND_LEVEL_LABELS = ["co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "in"]
INDEX_FILE_REGEX = r"(?i)/(index|default|home)\.(html?|php|aspx?|jsp)$"
PAGE_SUFFIX_REGEX = r"(?i)\.(html?|php|aspx?|jsp)$"
SHAPEFILE_ZIP_REGEX = r"(?i)(^|[-_.])(shp|shape|shapefile|gis)([-_.]|$)"
RESPONSIVE_SUFFIX_REGEX = (
    r"(?i)[-_@]((\d{2,5})x(\d{2,5})|\d{1,2}x|scaled|thumb(nail)?|small|medium|large|mobile|desktop"
    r"|retina|\d{2,5}w)$"
)
BLOCKED_PORTS = [
    22, 23, 25, 53, 110, 135, 137, 138, 139, 143, 445, 465, 587, 593, 636, 993, 995, 1433, 1521,
    2049, 2375, 2376, 3306, 3389, 5432, 5672, 5900, 5984, 6379, 9200, 9300, 11211, 27017,
]
MAX_URL_LENGTH = 2048
IPV4_BLOCKS = [
    ("0.0.0.0/8", "unspecified address block"),
    ("10.0.0.0/8", "private network (RFC 1918)"),
    ("100.64.0.0/10", "carrier-grade NAT (RFC 6598)"),
    ("127.0.0.0/8", "loopback address"),
    ("169.254.0.0/16", "link-local / cloud metadata address"),
    ("172.16.0.0/12", "private network (RFC 1918)"),
    ("192.0.0.0/24", "IETF protocol assignments"),
    ("192.0.2.0/24", "documentation range"),
    ("192.88.99.0/24", "deprecated 6to4 relay anycast"),
    ("192.168.0.0/16", "private network (RFC 1918)"),
    ("198.18.0.0/15", "benchmarking range"),
    ("198.51.100.0/24", "documentation range"),
    ("203.0.113.0/24", "documentation range"),
    ("224.0.0.0/4", "multicast range"),
    ("240.0.0.0/4", "reserved range"),
]
BLOCKED_HOSTNAMES = [
    (r"^localhost$", "localhost is not a public host"),
    (r"\.localhost$", "localhost is not a public host"),
    (r"^ip6-\w+$", "loopback alias"),
    (r"\.local$", "mDNS / local network name"),
    (r"\.internal$", "internal network name"),
    (r"\.intranet$", "internal network name"),
    (r"\.lan$", "local network name"),
    (r"\.home$", "local network name"),
    (r"\.corp$", "internal network name"),
    (r"\.private$", "internal network name"),
    (r"^metadata(\.google\.internal)?$", "cloud metadata endpoint"),
    (r"^instance-data(\..*)?$", "cloud metadata endpoint"),
]

# --- Reference extraction: fixed values -----------------------------------------------------
LAZY_SRC_ATTRIBUTES = [
    "data-src", "data-original", "data-lazy-src", "data-lazy", "data-echo", "data-url",
    "data-image", "data-img", "data-image-src", "data-full-src", "data-large", "data-large-file",
    "data-large_image", "data-medium-file", "data-hi-res-src", "data-thumb", "data-thumbnail",
    "data-poster", "data-bg", "data-background", "data-background-image", "data-bg-src",
    "data-defer-src", "data-cfsrc", "data-srcset-fallback",
]
LAZY_SRCSET_ATTRIBUTES = ["data-srcset", "data-lazy-srcset", "data-original-set", "data-responsive"]
ICON_RELS = [
    "icon", "shortcut icon", "apple-touch-icon", "apple-touch-icon-precomposed", "mask-icon",
    "fluid-icon", "apple-touch-startup-image",
]
META_IMAGE_KEYS = {
    "og:image": "og-image",
    "og:image:url": "og-image",
    "og:image:secure_url": "og-image",
    "twitter:image": "twitter-image",
    "twitter:image:src": "twitter-image",
    "twitter:image0": "twitter-image",
    "msapplication-tileimage": "meta-other",
    "thumbnail": "meta-other",
    "image": "meta-other",
    "vk:image": "meta-other",
}
GEO_DATA_ATTRIBUTES = [
    "data-kml", "data-file", "data-layer", "data-src", "data-url", "data-geojson", "data-map",
]
JSONLD_IMAGE_KEYS = [
    "image", "images", "logo", "thumbnail", "thumbnailurl", "contenturl", "primaryimageofpage",
    "photo", "screenshot", "icon",
]
CSS_IMAGE_PROPERTY_REGEX = (
    r"(?i)(background(?:-image)?|border-image(?:-source)?|list-style(?:-image)?|mask(?:-image)?"
    r"|content|cursor|src)\s*:"
)
DISCOVERY_SOURCES = [
    "img", "srcset", "picture-source", "lazy-attribute", "og-image", "twitter-image", "meta-other",
    "link-icon", "css-inline", "css-stylesheet", "schema-org", "video-poster", "svg-image",
    "input-image", "anchor-href", "data-attribute", "map-embed",
]

# --- Sitemaps: fixed values -----------------------------------------------------------------
MAX_SITEMAP_URLS = 300
MAX_SITEMAP_FOLLOWS = 3

# --- Classification: fixed values -----------------------------------------------------------
MAP_WORDS = [
    "map", "maps", "townplan", "town", "plan", "tpscheme", "tp", "masterplan", "layout",
    "cadastral", "survey", "zone", "zoning", "parcel", "plot", "gis", "satellite", "aerial",
    "topography", "topo", "contour", "route", "boundary", "district", "ward", "sector",
    "landuse", "scheme", "blueprint", "siteplan", "floorplan", "atlas", "cartogram",
]
CATEGORY_KEYWORDS = [
    ("map", 3, MAP_WORDS),
    ("logo", 3, ["logo", "logotype", "brand", "branding", "wordmark", "lockup", "emblem", "monogram"]),
    ("icon", 3, ["icon", "icons", "favicon", "sprite", "glyph", "symbol", "pictogram", "bullet",
                 "arrow", "chevron", "caret", "badge"]),
    ("thumbnail", 2, ["thumb", "thumbs", "thumbnail", "preview", "tiny", "mini", "small", "crop"]),
    ("background", 2, ["bg", "background", "backdrop", "hero", "banner", "cover", "pattern",
                       "texture", "gradient", "overlay", "watermark"]),
    ("screenshot", 2, ["screenshot", "screenshots", "screen", "screengrab", "capture", "demo", "ui"]),
    ("illustration", 2, ["illustration", "illustrations", "vector", "drawing", "graphic", "artwork",
                         "sketch", "cartoon", "doodle", "shape", "blob"]),
    ("photo", 1, ["photo", "photos", "photograph", "picture", "gallery", "dsc", "dscn", "img",
                  "image", "portrait", "team", "staff", "building", "site", "project"]),
]
SOURCE_SIGNALS = [
    ("link-icon", "icon", 6, 'declared as a site icon via <link rel="icon">'),
    ("og-image", "photo", 2, "used as the Open Graph sharing image"),
    ("twitter-image", "photo", 2, "used as the Twitter/X card image"),
    ("css-inline", "background", 3, "referenced from a CSS background declaration"),
    ("css-stylesheet", "background", 3, "referenced from a stylesheet background declaration"),
    ("video-poster", "thumbnail", 3, "used as a video poster frame"),
    ("input-image", "icon", 2, "used as an image input control"),
]

# --- Labels: fixed values -------------------------------------------------------------------
SIZE_LABELS = {
    "tiny": "Tiny (under 100 px)", "small": "Small (100–399 px)", "medium": "Medium (400–999 px)",
    "large": "Large (1000–1999 px)", "very-large": "Very large (2000 px +)",
}
CATEGORY_LABELS = {
    "map": "Map", "logo": "Logo", "icon": "Icon", "photo": "Photo", "illustration": "Illustration",
    "thumbnail": "Thumbnail", "background": "Background", "screenshot": "Screenshot",
}
ORIENTATION_LABELS = {
    "landscape": "Landscape", "portrait": "Portrait", "square": "Square", "panorama": "Panorama",
}
STATUS_LABELS = {
    "available": "Available", "unavailable": "Unavailable", "redirected": "Redirected",
    "duplicate": "Duplicate", "unsupported": "Unsupported",
}
KIND_LABELS = {"geo": "Geographic data"}
DISCOVERY_LABELS = {
    "img": "IMG", "srcset": "SRCSET", "picture-source": "PICTURE", "lazy-attribute": "LAZY ATTR",
    "og-image": "OG IMAGE", "twitter-image": "TWITTER CARD", "schema-org": "JSON-LD",
    "link-icon": "SITE ICON", "css-inline": "CSS INLINE", "css-stylesheet": "CSS SHEET",
    "video-poster": "VIDEO POSTER", "svg-image": "SVG IMAGE", "input-image": "INPUT IMAGE",
    "anchor-href": "PAGE LINK", "data-attribute": "DATA ATTR", "map-embed": "MAP EMBED",
}
HTTP_MESSAGES = {
    401: "This resource requires authentication, so the scanner did not retrieve it.",
    402: "This resource is behind a payment requirement and was not retrieved.",
    403: "The server did not permit the scanner to retrieve this resource.",
    404: "The server reported that this resource does not exist.",
    410: "The server reported that this resource has been removed.",
    429: "The server asked the scanner to slow down (rate limited).",
    451: "The server reported this resource is unavailable for legal reasons.",
    500: "The server reported an error while serving this resource.",
    502: "The server reported an error while serving this resource.",
    503: "The server reported an error while serving this resource.",
    504: "The server reported an error while serving this resource.",
}
PAGE_HTTP_DETAILS = {
    403: "The page did not permit the scanner to retrieve its contents.",
    401: "This page requires authentication, which the scanner does not attempt.",
    404: "The server reported that this page does not exist.",
    429: "The server asked the scanner to slow down. Increase the request delay and try again.",
}
PAGE_HTTP_DEFAULT = "The server did not return the page contents."
MIME_BY_TYPE = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "avif": "image/avif", "bmp": "image/bmp",
    "ico": "image/x-icon", "tiff": "image/tiff", "heif": "image/heif",
}
GEO_CONTENT_TYPE_REGEX = (
    r"(?i)^(application/vnd\.google-earth|application/(geo\+)?json|application/(x-)?zip"
    r"|application/(xml|octet-stream|gpx\+xml|gml\+xml)|text/(xml|plain|json))"
)

# --- Land records: fixed values -------------------------------------------------------------
REFERENCE_KEYS = [
    "survey_no", "surveyno", "survey", "survey_number", "sno", "s_no", "parcel", "parcel_id",
    "parcelid", "plot", "plot_no", "final_plot", "fp_no", "khasra", "gat_no", "block_no",
    "reference", "ref",
]
SURVEY_REGEXES = [
    r"(?i)\b(?:survey|sy)\b\.?\s*(?:no\.?|number)?\s*[:.]?\s*(\d+[\w/-]*)",
    r"(?i)\bs\.?\s*no\.?\s*[:.]?\s*(\d+[\w/-]*)",
    r"(?i)\b(?:final\s*plot|f\.?\s*p\.?)\s*(?:no\.?|number)?\s*[:.]?\s*(\d+[\w/-]*)",
    r"(?i)\b(?:block|khasra|gat|hissa)\s*(?:no\.?|number)?\s*[:.]?\s*(\d+[\w/-]*)",
    r"^(\d{1,5}(?:/\d{1,4})+(?:/[A-Za-z])?)$",
]
PLACE_KEYS = [
    ("village", ["village", "village_name", "vill", "gram"]),
    ("town", ["town", "town_name", "nagar"]),
    ("city", ["city", "city_name"]),
    ("taluka", ["taluka", "tehsil", "taluk", "mandal", "block"]),
    ("district", ["district", "dist", "district_name"]),
    ("state", ["state", "state_name"]),
    ("locality", ["locality", "ward", "sector", "area"]),
]
PLACE_ORDER = ["state", "district", "taluka", "city", "town", "village", "locality"]
KIND_WORDS = [
    ("village", ["village", "gram", "gaon"]),
    ("town", ["town", "nagar"]),
    ("city", ["city", "municipal", "corporation", "mahanagar"]),
    ("taluka", ["taluka", "tehsil", "taluk", "mandal"]),
    ("district", ["district", "dist", "jilla"]),
    ("state", ["state"]),
    ("locality", ["locality", "ward", "sector"]),
    ("map-area", ["tp", "scheme", "survey", "map"]),
]
GEOJSON_NAME_KEYS = ["name", "Name", "NAME", "title", "label", "survey_no", "survey", "parcel"]
GEOJSON_DESCRIPTION_KEYS = ["description", "Description", "desc", "remarks"]
SQUARE_METRES_PER_ACRE = 4046.8564224
SQUARE_METRES_PER_HECTARE = 10_000
MAX_LINKED_IMAGES = 12
LINK_REASONS = {
    "overlay": "The source publishes this image as a georeferenced overlay for this area.",
    "wording": "Found on the same page, and the image text shares wording with the parcel name.",
    "place": "Found on the same page, and the image text mentions the same place.",
    "page": "Found on the same page as the geometry, with nothing further tying them together.",
    "itself": "This record is the image itself; no separate association was needed.",
}

# --- Geometry and coordinate systems: fixed values ------------------------------------------
GEOMETRY_TYPES = ["Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString", "MultiPoint"]
EARTH_RADIUS = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
MERCATOR_MAX_LATITUDE = 85.05112878
OUT_OF_RANGE_WARNING = (
    "Some coordinates fell outside the valid longitude/latitude range and were dropped. "
    "That usually means the file is in a projected system it did not declare."
)
NO_FEATURES_WARNING = "No features could be read from this file."
KMZ_NO_KML_WARNING = "The KMZ archive contained no KML document."
KMZ_UNREADABLE_WARNING = "The KMZ archive could not be read."
BAD_JSON_WARNING = "The file is not valid JSON."

# --- Retention and export limits: fixed values ----------------------------------------------
MAX_SCANS = 12
SCAN_TTL_HOURS = 2
PAGE_LOG_KEEP, PAGE_LOG_RETURN = 1000, 300
ISSUE_LOG_KEEP, ISSUE_LOG_RETURN = 400, 120
MAX_ARCHIVE_FILES = 500
MAX_ARCHIVE_BYTES = 1024 * 1024 * 1024
MAX_FILE_BYTES = 64 * 1024 * 1024
MAX_EXPORT_RECORDS = 2000
MAX_ARCHIVE_ENTRIES = 65_535
EXPORT_NOTICE = (
    "These are references and metadata for publicly accessible images discovered on the scanned "
    "site. Rights to the images themselves remain with their owners."
)
CSV_HEADER = [
    "Filename", "Image URL", "Source Page", "Width", "Height", "Format", "Alt Text", "Category",
    "Discovery Method", "Status", "File Size (bytes)", "Pages Found On", "References", "Duplicate Of",
]
