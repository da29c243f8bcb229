"""Trackers: the globals, hosts and cookies that give each one away, and the patterns of their tag ids."""

from crawlsift.registry.rows import parse_rows

# Categories in display order.
TRACKER_CATEGORIES = [
    ("consent", "Consent management"),
    ("tag-manager", "Tag managers"),
    ("analytics", "Analytics"),
    ("advertising", "Advertising"),
    ("session", "Session replay & heatmaps"),
    ("support", "Support & chat"),
    ("monitoring", "Error monitoring"),
]

# Id | name | category | globals | hosts (or any subdomain) | cookie names (or anything they start)
TRACKERS = parse_rows(
    """
onetrust | OneTrust | consent | OneTrust | cdn.cookielaw.org,onetrust.com | OptanonConsent,OptanonAlertBoxClosed
cookiebot | Cookiebot | consent | Cookiebot | consent.cookiebot.com | CookieConsent
didomi | Didomi | consent | Didomi | sdk.privacy-center.org | didomi_token,euconsent-v2
axeptio | Axeptio | consent | axeptioSDK | static.axept.io | axeptio_authorized_vendors
usercentrics | Usercentrics | consent | UC_UI | app.usercentrics.eu
osano | Osano | consent | Osano | cmp.osano.com
trustarc | TrustArc | consent | truste | consent.trustarc.com
klaro | Klaro | consent | klaro |  | klaro
gtm | Google Tag Manager | tag-manager | google_tag_manager | googletagmanager.com
tealium | Tealium | tag-manager | utag | tags.tiqcdn.com
segment | Segment | tag-manager | analytics | cdn.segment.com | ajs_anonymous_id
ga4 | Google Analytics | analytics | gtag,ga,GoogleAnalyticsObject | google-analytics.com,analytics.google.com | _ga,_gid
matomo | Matomo | analytics | _paq,Matomo | matomo.cloud | _pk_id
plausible | Plausible | analytics | plausible | plausible.io
fathom | Fathom | analytics | fathom | cdn.usefathom.com
umami | Umami | analytics | umami | umami.is
mixpanel | Mixpanel | analytics | mixpanel | cdn.mxpnl.com
amplitude | Amplitude | analytics | amplitude | cdn.amplitude.com
posthog | PostHog | analytics | posthog | posthog.com
heap | Heap | analytics | heap | cdn.heapanalytics.com
hubspot | HubSpot | analytics | _hsq | js.hs-scripts.com,js.hsadspixel.net | hubspotutk
meta | Meta Pixel | advertising | fbq,_fbq | connect.facebook.net | _fbp
google-ads | Google Ads | advertising |  | googleadservices.com,googlesyndication.com,doubleclick.net | _gcl_au
tiktok | TikTok Pixel | advertising | ttq | analytics.tiktok.com
x-ads | X (Twitter) Pixel | advertising | twq | static.ads-twitter.com
snapchat | Snap Pixel | advertising | snaptr | sc-static.net
pinterest | Pinterest Tag | advertising | pintrk | s.pinimg.com
linkedin | LinkedIn Insight | advertising | lintrk | snap.licdn.com
bing | Microsoft Ads (UET) | advertising | uetq | bat.bing.com
reddit | Reddit Pixel | advertising | rdt | redditstatic.com
criteo | Criteo | advertising |  | static.criteo.net
hotjar | Hotjar | session | hj,hjSiteSettings | static.hotjar.com,script.hotjar.com | _hjSessionUser
clarity | Microsoft Clarity | session | clarity | clarity.ms | _clck
logrocket | LogRocket | session | LogRocket | cdn.logrocket.io
fullstory | FullStory | session | FS | edge.fullstory.com
smartlook | Smartlook | session | smartlook | web-sdk.smartlook.com
intercom | Intercom | support | Intercom | widget.intercom.io
zendesk | Zendesk | support | zE | static.zdassets.com
drift | Drift | support | drift | js.driftt.com
sentry | Sentry | monitoring | Sentry | browser.sentry-cdn.com
newrelic | New Relic | monitoring | newrelic | js-agent.newrelic.com
datadog | Datadog RUM | monitoring | DD_RUM | datadoghq-browser-agent.com
""",
    ["id", "name", "category", "globals", "hosts", "cookies"],
    ["globals", "hosts", "cookies"],
)

# Global names whose presence on a page is recorded.
WATCHED_GLOBALS = """
dataLayer google_tag_manager gtag ga GoogleAnalyticsObject fbq _fbq ttq twq snaptr pintrk lintrk uetq rdt hj
hjSiteSettings clarity _hsq analytics mixpanel amplitude posthog heap Intercom zE drift _paq Matomo plausible
fathom umami dataLayerGA4 Shopify ShopifyAnalytics OneTrust Cookiebot Didomi __tcfapi axeptioSDK UC_UI Osano
truste _sp_ klaro CookieConsent Sentry newrelic DD_RUM LogRocket FS smartlook
""".split()

# Fixed values: (label, pattern, group holding the id)
ID_PATTERNS = [
    ("GTM container", r"\bGTM-[A-Z0-9]{4,10}\b", 0),
    ("GA4 measurement", r"\bG-[A-Z0-9]{6,12}\b", 0),
    ("Universal Analytics", r"\bUA-\d{4,10}-\d{1,4}\b", 0),
    ("Google Ads", r"\bAW-\d{6,14}\b", 0),
    ("Floodlight", r"\bDC-\d{6,14}\b", 0),
    ("Meta Pixel", r"""fbq\s*\(\s*['"]init['"]\s*,\s*['"](\d{6,20})['"]""", 1),
    ("Hotjar site", r"hjid\s*[:=]\s*(\d{4,12})", 1),
    ("Clarity project", r"clarity\.ms/tag/([a-z0-9]{6,15})", 1),
]
