"""What each structured-data type needs: required properties missing are errors, recommended ones warnings."""

from crawlsift.registry.rows import parse_rows

# Type | aliases | required | recommended
REQUIREMENTS = parse_rows(
    """
Article | NewsArticle,BlogPosting,TechArticle,ScholarlyArticle | headline | image,datePublished,author,publisher
Product |  | name | image,description,offers,sku,brand
ProductGroup | ProductModel | name | image,description,hasVariant,productGroupID,variesBy,brand
Offer |  | price,priceCurrency | availability,url
AggregateOffer |  | lowPrice,priceCurrency | highPrice,offerCount
Review |  | reviewRating,author | datePublished,reviewBody
AggregateRating |  | ratingValue | reviewCount,bestRating
BreadcrumbList |  | itemListElement
Organization | Corporation,NGO,OnlineBusiness | name | url,logo,sameAs
LocalBusiness | Restaurant,Store,ProfessionalService | name,address | telephone,openingHours,geo,priceRange
Person |  | name | url,jobTitle
WebSite |  | name,url | potentialAction
WebPage | ItemPage,CollectionPage,AboutPage,ContactPage |  | name,description
FAQPage |  | mainEntity
Question |  | name,acceptedAnswer
Recipe |  | name | image,recipeIngredient,recipeInstructions,author,cookTime
Event |  | name,startDate | location,endDate,offers,description
VideoObject |  | name,description,thumbnailUrl,uploadDate | duration,contentUrl
ImageObject |  |  | url,contentUrl,width,height
JobPosting |  | title,description,datePosted,hiringOrganization | jobLocation,baseSalary,employmentType
SoftwareApplication |  | name | applicationCategory,operatingSystem,offers,aggregateRating
""",
    ["type", "aliases", "required", "recommended"],
    ["aliases", "required", "recommended"],
)
