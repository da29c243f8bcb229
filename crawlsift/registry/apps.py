"""Storefront apps recognised by the host their scripts come from."""

from crawlsift.registry.rows import parse_rows

# Id | name | host (or any subdomain)
APPS = parse_rows(
    """
klaviyo | Klaviyo | klaviyo.com
judgeme | Judge.me | judge.me
loox | Loox | loox.io
yotpo | Yotpo | yotpo.com
okendo | Okendo | okendo.io
stamped | Stamped | stamped.io
recharge | Recharge | rechargecdn.com
gorgias | Gorgias | gorgias.chat
tidio | Tidio | tidio.co
smile | Smile.io | smile.io
privy | Privy | privy.com
attentive | Attentive | attentivemobile.com
postscript | Postscript | postscript.io
pagefly | PageFly | pagefly.io
shogun | Shogun | getshogun.com
rebuy | Rebuy | rebuyengine.com
zipify | Zipify | zipify.com
vitals | Vitals | vitals.co
boost | Boost AI Search | bc-sf-filter.com
searchanise | Searchanise | searchserverapi.com
route | Route | route.com
luckyorange | Lucky Orange | luckyorange.com
backinstock | Back in Stock | backinstock.org
wiser | Wiser | expertvillagemedia.com
gempages | GemPages | gempages.net
omnisend | Omnisend | omnisend.com
mailchimp | Mailchimp | chimpstatic.com
bold | Bold Commerce | boldapps.net
loop | Loop Returns | loopreturns.com
returnly | Returnly | returnly.com
shipbob | ShipBob | shipbob.com
aftership | AfterShip | aftership.com
reviewsio | REVIEWS.io | reviews.io
trustpilot | Trustpilot | trustpilot.com
gorgias-convert | Gorgias Convert | gorgias.com
octaneai | Octane AI | octaneai.com
nosto | Nosto | nosto.com
dynamicyield | Dynamic Yield | dynamicyield.com
limespot | LimeSpot | limespot.com
justuno | Justuno | justuno.com
wisepops | Wisepops | wisepops.net
swell | Yotpo Loyalty | swellrewards.com
growave | Growave | growave.io
hextom | Hextom | hextom.com
avada | Avada | avada.io
tapcart | Tapcart | tapcart.com
searchspring | Searchspring | searchspring.io
algolia | Algolia | algolia.net
klarna | Klarna | klarna.com
afterpay | Afterpay / Clearpay | afterpay.com
affirm | Affirm | affirm.com
""",
    ["id", "name", "hosts"],
    ["hosts"],
)

# Asset hosts of the store platform, in order of preference.
STORE_HOSTS = ["cdn.shopify.com", "cdn.shopifycloud.com", "shopifycdn.net"]
