"""Technologies: globals, page markers, URL parts and generator names that give each one away."""

from crawlsift.registry.rows import parse_rows

# Categories in display order.
STACK_CATEGORIES = [
    ("framework", "JavaScript frameworks"),
    ("meta-framework", "Meta frameworks"),
    ("cms", "CMS & site builders"),
    ("ecommerce", "E-commerce"),
    ("ui", "UI & CSS"),
    ("library", "Libraries"),
    ("tooling", "Build tooling"),
]

# Id | name | category | globals | markers | URL parts | generator pattern | key of the version
TECHNOLOGIES = parse_rows(
    """
react | React | framework | React,__REACT_DEVTOOLS_GLOBAL_HOOK__ | data-reactroot |  |  | react
vue | Vue | framework | Vue,__VUE__,__VUE_DEVTOOLS_GLOBAL_HOOK__ | vue-app |  |  | vue
angular | Angular | framework | getAllAngularRootElements | ng-version |  |  | angular
angularjs | AngularJS | framework | angular | angularjs |  |  | angularjs
svelte | Svelte | framework | __svelte | svelte
ember | Ember | framework | Ember
backbone | Backbone | framework | Backbone
alpine | Alpine.js | framework | Alpine | alpine |  |  | alpine
htmx | htmx | framework | htmx | htmx
stimulus | Stimulus | framework | Stimulus | stimulus
livewire | Livewire | framework | Livewire | livewire
next | Next.js | meta-framework | __NEXT_DATA__ | next-root | /_next/
nuxt | Nuxt | meta-framework | __NUXT__,$nuxt | nuxt-root | /_nuxt/
sveltekit | SvelteKit | meta-framework | __sveltekit |  | /_app/immutable/
remix | Remix | meta-framework | __remixContext
astro | Astro | meta-framework | astro,__astro | astro |  | astro
turbo | Hotwire Turbo | meta-framework | Turbo | turbo
blazor | Blazor | meta-framework | Blazor
wordpress | WordPress | cms | wp |  | /wp-content/,/wp-includes/ | wordpress
elementor | Elementor | cms | elementorFrontend | elementor | /elementor/
drupal | Drupal | cms | Drupal |  | /sites/default/files/ | drupal
joomla | Joomla | cms |  |  | /media/jui/ | joomla
ghost | Ghost | cms |  |  | /assets/built/ | ghost
webflow | Webflow | cms | Webflow |  | assets.website-files.com,uploads-ssl.webflow.com | webflow
squarespace | Squarespace | cms | Squarespace |  | static1.squarespace.com
wix | Wix | cms | wixPerformanceMeasurements |  | static.parastorage.com | wix\\.com
hubspot-cms | HubSpot CMS | cms |  |  | hs-sites.com,hubspotusercontent | hubspot
shopify | Shopify | ecommerce | Shopify |  | cdn.shopify.com,cdn.shopifycloud.com
woocommerce | WooCommerce | ecommerce | woocommerce_params | woocommerce | /woocommerce/ | woocommerce
prestashop | PrestaShop | ecommerce | PrestaShop |  |  | prestashop
magento | Magento | ecommerce | Magento |  | /static/version,/mage/
bigcommerce | BigCommerce | ecommerce |  |  | cdn11.bigcommerce.com
bootstrap | Bootstrap | ui | bootstrap | bootstrap | bootstrap.min.css,bootstrap.bundle
tailwind | Tailwind CSS | ui |  | tailwind | cdn.tailwindcss.com
fontawesome | Font Awesome | ui |  |  | font-awesome,fontawesome
google-fonts | Google Fonts | ui |  |  | fonts.googleapis.com,fonts.gstatic.com
swiper | Swiper | ui | Swiper |  | swiper
aos | AOS | ui | AOS
jquery | jQuery | library | jQuery |  | jquery |  | jquery
lodash | Lodash / Underscore | library | _ |  | lodash,underscore
axios | Axios | library | axios |  | axios
moment | Moment.js | library | moment |  | moment |  | moment
dayjs | Day.js | library | dayjs |  | dayjs
gsap | GSAP | library | gsap |  | gsap
three | Three.js | library | THREE |  | three.min.js
d3 | D3 | library | d3 |  | d3.min.js |  | d3
lottie | Lottie | library | Lottie,lottie |  | lottie
webpack | webpack | tooling | webpackChunk,__webpack_require__
vite | Vite | tooling | __vite__ |  | /@vite/,/assets/index-
cloudflare | Cloudflare | tooling |  |  | cdnjs.cloudflare.com,/cdn-cgi/
jsdelivr | jsDelivr | tooling |  |  | cdn.jsdelivr.net
""",
    ["id", "name", "category", "globals", "markers", "paths", "generator", "version"],
    ["globals", "markers", "paths"],
)

# Global names whose presence on a page is recorded.
WATCHED_GLOBALS = """
React ReactDOM __REACT_DEVTOOLS_GLOBAL_HOOK__ __NEXT_DATA__ next Vue __VUE__ __VUE_DEVTOOLS_GLOBAL_HOOK__
__NUXT__ $nuxt ng angular getAllAngularRootElements __svelte __sveltekit Ember Backbone Alpine htmx Stimulus
Turbo Livewire jQuery $ _ axios moment dayjs gsap THREE d3 bootstrap Swiper AOS Lottie lottie Shopify
Squarespace wixPerformanceMeasurements Webflow Drupal wp elementorFrontend woocommerce_params PrestaShop
Magento webpackChunk __webpack_require__ __vite__ __remixContext astro __astro Blazor Sentry dataLayer
""".split()

# Marker -> what an open tag must satisfy. `attr` any of these attributes is present, `id` any of these
# ids, `class` all of one of these class sets, `class_part` a part of the class attribute, `tag` an element name.
MARKERS = {
    "data-reactroot": {"attr": ["data-reactroot"]},
    "next-root": {"id": ["__next"]},
    "nuxt-root": {"id": ["__nuxt", "__nuxt_layout"]},
    "vue-app": {"attr": ["data-v-app"]},
    "ng-version": {"attr": ["ng-version"]},
    "angularjs": {"attr": ["ng-app", "data-ng-app"]},
    "svelte": {"class_part": ["svelte-"]},
    "astro": {"attr": ["astro-island"], "tag": ["astro-island"]},
    "livewire": {"attr": ["wire:id"]},
    "turbo": {"attr": ["data-turbo"]},
    "stimulus": {"attr": ["data-controller"]},
    "htmx": {"attr": ["hx-get", "hx-post", "data-hx-get"]},
    "alpine": {"attr": ["x-data"]},
    "elementor": {"class": [["elementor-widget"]]},
    "gravity-forms": {"class": [["gform_wrapper"]]},
    "woocommerce": {"class": [["woocommerce"]]},
    "bootstrap": {"class": [["container-fluid"], ["navbar-toggler"]]},
    "tailwind": {"class": [["flex", "items-center"], ["sr-only"]]},
}
