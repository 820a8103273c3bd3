"""The catalogs as text: fixed values, in their own order. catalogs.py reads them into tables.

A line in brackets names the group (of rules) or dimension (of signals) of the lines below it.
"""

#: Rules: number in the group | name | keywords, all of which a text must have. Fixed values.
RULES = """
[service-capacity]
01 | ABA intake waitlist announcements | aba; waitlist
02 | ABA temporary intake closures | aba; not accepting
03 | ABA reopening intake | aba; accepting new
04 | New ABA therapy clinic announced | aba; opening
05 | Existing ABA clinic closure announced | aba; closing
06 | Public appointment lead times | appointment; wait
07 | Published service capacity expansion | aba; capacity
08 | Rural outreach clinic schedule | mobile clinic; therapy
09 | Parent training program availability | parent training; available
10 | After school therapy slots | after school; therapy
[institutional-demand]
01 | Regional early intervention program growth | early intervention; expand
02 | Child Find referral initiative | child find; referral
03 | Public school inclusion program expansion | inclusive classroom; expand
04 | Special education personnel vacancy | special education; vacanc
05 | Special education district funding award | special education; grant
06 | Disability services program grant award | disability services; grant
07 | Autism services agency contract opportunity | autism; contract
08 | County-wide developmental screening event | developmental screening; event
09 | Public pediatric specialty expansion | pediatric; expand
10 | Public early childhood service shortage | early childhood; shortage
[community-context]
01 | Public local forum about service availability | services; availability
02 | Aggregated multi-thread waiting list themes | waitlist; therapy
03 | Public autism advocacy event announced | autism awareness; event
04 | Municipal autism awareness traffic safety campaign | autism; traffic safety
05 | Public library autism resource event | library; autism
06 | Local newspaper developmental services coverage | local; autism services
07 | Nonprofit support-group program announcement | support group; program
08 | County autism resource fair | autism; resource fair
09 | Public town hall accessibility agenda | accessibility; town hall
10 | Community sensory accessibility program | sensory friendly; program
[referral-pathways]
01 | Hospital pediatric referral partnership | hospital; referral
02 | Speech therapy referral pathway | speech therapy; referral
03 | Occupational therapy referral program | occupational therapy; referral
04 | Public preschool developmental referral information | preschool; developmental referral
05 | Licensed daycare inclusion program | daycare; inclusion
06 | Early intervention local contact network | early intervention; contact
07 | Regional family resource agency directory | family resource; directory
08 | School district Child Find outreach | child find; outreach
09 | Public autism evaluation clinic referral path | autism evaluation; referral
10 | Nonprofit developmental support referral service | developmental support; referral
[workforce-friction]
01 | RBT job advertisement growth | rbt; hiring
02 | BCBA job advertisement growth | bcba; hiring
03 | Advertised technician pay increase | technician; pay
04 | Advertised analyst salary increase | behavior analyst; salary
05 | Published clinician vacancy duration | clinician; unfilled
06 | Public behavior tech training cohort | rbt; training
07 | University behavior analysis graduate program | behavior analysis; graduate
08 | Public technician apprenticeship | behavior technician; apprentice
09 | BCBA clinical director role opening | clinical director; bcba
10 | Employer RBT sign-on bonus | rbt; sign-on
[market-validation]
01 | ABA provider directory changed | aba; provider directory
02 | Insurance ABA network expansion | aba; network expansion
03 | Medicaid provider notice affecting ABA | medicaid; aba notice
04 | Clinic commercial payer contracting announcement | aba; contracting
05 | Provider geographic service-area change | aba; service area
06 | Public construction or lease of ABA clinic | aba; new clinic
07 | County public health needs assessment | community health; needs assessment
08 | Regional transportation access barrier | rural; transportation barrier
09 | Official licensing or inspection change | aba; license inspection
10 | Time-separated independent reporting of service gap | therapy shortage; report
"""

#: Rules on programs for ages 2 to 18, likewise. Fixed values.
AGE_RULES = """
[school-service-access]
01 | Elementary behavioral therapy referral | elementary school; behavior therapy
02 | School social worker service navigation | school social worker; resources
03 | District youth counseling waitlist | school district; waitlist
04 | Public special education staffing gap | special education; staff shortage
05 | School psychologist coverage update | school psychologist; staffing
06 | District developmental services partnership | district; developmental services
07 | Summer extended school-year program expansion | extended school year; expand
08 | Transition to kindergarten support capacity | kindergarten; support program
09 | District special education parent workshop | special education; workshop
10 | Public school-to-clinic referral protocol | school; clinic referral
[preschool-service-access]
01 | Preschool inclusive classroom waitlist | preschool; inclusion waitlist
02 | Public preschool screening schedule | preschool; developmental screening
03 | Early childhood evaluation appointment | early childhood; evaluation appointment
04 | Preschool speech-language service expansion | preschool; speech therapy
05 | Head Start disability inclusion announcement | head start; disability inclusion
06 | Preschool family resource program | preschool; family resource
07 | Inclusive toddler preschool ages 2–5 | ages 2-5; inclusive preschool
08 | Early childhood mental health consultation | preschool; mental health consultation
09 | Preschool special education staffing grant | preschool; special education grant
10 | Public pre-K transition meeting schedule | pre-k; transition meeting
[adolescent-access]
01 | Teen autism community program expansion | teen; autism program
02 | High school related services availability | high school; related services
03 | School-age adolescent therapy scheduling | adolescent; therapy appointments
04 | School district adolescent support group | school district; teen support group
05 | Teen respite provider public program | teen; respite program
06 | High school behavioral consultation contract | high school; behavioral consultation
07 | Youth ages 13–18 assessment capacity | ages 13-18; assessment
08 | Teen after-school skill-building program | teen; after school skills
09 | Public secondary school neurodiversity initiative | high school; neurodiversity
10 | Teen autism resource navigation directory | teen; autism resources
[evaluation-navigation]
01 | School-age diagnostic clinic openings | school age; diagnostic clinic
02 | Developmental assessment scheduling backlog | developmental assessment; waitlist
03 | Pediatric neuropsychology referral instructions | pediatric neuropsychology; referral
04 | Autism evaluation referral wait times | autism evaluation; wait time
05 | Early childhood evaluation scheduling service | preschool; evaluation center
06 | Multidisciplinary youth diagnostic team | youth; multidisciplinary evaluation
07 | Regional child development intake form | child development; intake form
08 | School district assessment referral form | school district; assessment referral
09 | Pediatric developmental screening event | pediatric; screening event
10 | Hospital pediatric service navigation | children hospital; referral navigation
[school-board-signals]
01 | Special education contract award | school board; special education contract
02 | Youth behavioral health RFP | school district; behavioral health rfp
03 | School psychologist hiring budget | school board; school psychologist budget
04 | Extended school-year transport award | extended school year; transport contract
05 | Public inclusive classroom capital budget | school board; inclusive classroom
06 | District preschool enrollment growth briefing | school board; preschool enrollment
07 | Special education consultant procurement | special education; consultant procurement
08 | District Medicaid billing program update | school district; medicaid services
09 | School board child find capacity hearing | school board; child find
10 | Municipal adolescent service grant | city council; teen services grant
[public-health-programs]
01 | County child wellness strategic plan | county health; child wellness
02 | Children's developmental screening coalition | child development; coalition
03 | Public health youth disability program | public health; youth disability
04 | County early childhood resource gap report | county; early childhood resource gap
05 | Regional pediatric behavior service pilot | pediatric; behavior services pilot
06 | Hospital school-age clinic schedule | hospital; school age clinic
07 | Published public children's therapy partnership | children; therapy partnership
08 | Youth behavioral health community needs assessment | youth behavioral health; needs assessment
09 | Children's mental health workforce grant | children mental health; workforce grant
10 | County child transportation clinic access | county; child clinic transportation
[community-organizations]
01 | Local autism resource fair venue | autism resource fair; public library
02 | County sensory-friendly theater program | county; sensory friendly theatre
03 | Municipal inclusive playground programming | city; inclusive playground program
04 | Municipal child road-safety awareness campaign | municipal; autism safety campaign
05 | Public library sensory program funding | library; sensory program grant
06 | School PTA developmental resource event | pta; developmental resources
07 | Youth disability sports recreation expansion | youth; adaptive recreation
08 | Nonprofit school-age respite event | school age; respite nonprofit
09 | Public neighborhood disability access committee | city; disability access committee
10 | Accessible after-school community arts schedule | after school; sensory friendly arts
[mobility-access]
01 | School-age therapy transport hardship report | school bus; therapy transport shortage
02 | Accessible clinic bus route expansion | pediatric clinic; bus route
03 | Paratransit youth appointment schedule | youth; paratransit appointments
04 | School district extended route shortage | school district; transportation shortage
05 | Rural pediatric specialty transport funding | rural; pediatric transport grant
06 | Transit accessible child therapy center | transit; child therapy center
07 | Youth clinic vehicle grant awarded | youth clinic; transportation grant
08 | Public appointment shuttle for preschool | preschool; shuttle program
09 | After-school transportation extended coverage | after school; late bus
10 | City accessibility advisory pediatric route | city accessibility; pediatric transit
[after-school-seasonal]
01 | Autism-friendly school-age summer camp | school age; autism summer camp
02 | Summer camp additional inclusive slots | summer camp; inclusive enrollment
03 | After-school developmental services partnership | after school; developmental partnership
04 | Teen school-break respite availability | teen; school break respite
05 | Extended-day speech and OT services | after school; speech occupational therapy
06 | Public youth recreation waitlist | youth recreation; waitlist
07 | Inclusive after-school staffing increase | inclusive after school; hiring
08 | Autism-focused community weekend program | autism; weekend youth program
09 | Public district break-program expansion | school district; summer program expand
10 | After-school sensory-friendly library series | after school; sensory library
[clinic-market-movement]
01 | Child clinic new location announced | child therapy clinic; new location
02 | Adolescent outpatient program capacity expanded | teen outpatient; capacity expanded
03 | School-age therapy program temporarily closed | school age; therapy program closed
04 | Pediatric therapy program relaunch announced | pediatric therapy; reopening
05 | Child developmental clinic construction permit | child clinic; building permit
06 | Hospital pediatric behavioral services addition | hospital; pediatric behavioral services
07 | County ABA provider network pediatric gap | county aba; network gap
08 | Early childhood therapy lease expansion | preschool therapy; new lease
09 | School-age clinic service territory changed | school age clinic; service area changed
10 | Child development center relocates public program | child development center; relocating
[payer-public-notices]
01 | Child ABA benefit provider bulletin | child ABA; provider bulletin
02 | Pediatric ABA prior authorization update | pediatric ABA; prior authorization
03 | School-age Medicaid therapy access webinar | school age medicaid; therapy webinar
04 | Children therapy MCO network contracting | children therapy; network contracting
05 | Pediatric therapy billing code update | pediatric therapy; billing code
06 | Official age-limit pediatric ABA coverage | ages 2-18; ABA coverage
07 | Children behavioral health waiver change | children behavioral health; waiver
08 | Pediatric in-network directory update | pediatric therapy; in network directory
09 | School-based Medicaid behavioral service notice | school medicaid; behavioral services
10 | Public insurer pediatric referral coordination | insurance; pediatric referral coordination
[pediatric-workforce]
01 | Pediatric ABA BCBA hiring announcement | pediatric ABA; BCBA hiring
02 | Preschool behavior technician hiring | preschool; behavior technician hiring
03 | School-age RBT position open | school age; RBT hiring
04 | Youth behavior analyst supervising role | youth; BCBA supervisor
05 | Pediatric specialist recruitment grant | pediatric specialist; recruitment grant
06 | Special education teacher staffing crisis | special education teacher; staffing shortage
07 | Pediatric outpatient staff training cohort | pediatric outpatient; staff training
08 | Child behavior technician apprenticeship | child behavior; technician apprenticeship
09 | School BCBA contract positions | school; BCBA contracted
10 | Teen therapy clinical director opening | teen therapy; clinical director
"""

#: Groups whose rules are discussed in communities, so need a third publisher. Fixed values.
COMMUNITY_GROUPS = ("community-context", "community-organizations", "mobility-access")

#: Narrowing signals: weight | name | terms, all of which a text must have as whole words | states where it exists, any if none | search. Fixed values.
SIGNALS = """
[referral-gateway]
5 | Missouri First Steps early intervention | first steps; early intervention | MO | First Steps early intervention provider referral
5 | Kansas tiny-k early intervention | tiny-k | KS | tiny-k early intervention program
5 | Early Intervention Colorado | early intervention colorado | CO | Early Intervention Colorado local program
4 | Child Find developmental screening | child find |  | Child Find developmental screening ages 3-21
4 | Parents as Teachers | parents as teachers |  | Parents as Teachers developmental screening
4 | Part C early intervention | part c; early intervention
3 | Developmental screening program | developmental screening
4 | Early childhood special education | early childhood special education |  | early childhood special education program autism
3 | Infant-toddler services | infant toddler services
3 | Transition at age three | transition; age three
[disability-authority]
5 | SB 40 county disability board | sb 40 | MO | SB 40 board developmental disabilities services children
5 | Senate Bill 40 board | senate bill 40 | MO
5 | Children's Services Fund | children's services fund | MO | Children's Services Fund behavioral health grant
4 | DMH developmental disabilities regional office | regional office; developmental disabilities | MO
5 | CDDO | cddo | KS | CDDO community developmental disability organization
5 | Community Developmental Disability Organization | community developmental disability organization | KS
5 | Community Centered Board | community centered board | CO | Community Centered Board developmental disabilities children
4 | Case management agency | case management agency | CO
2 | Developmental disabilities council | developmental disabilities council
4 | County developmental disabilities board | developmental disabilities board
[medicaid-fit]
5 | MO HealthNet | mo healthnet | MO | MO HealthNet ABA autism provider
5 | KanCare | kancare | KS | KanCare ABA autism provider
5 | Health First Colorado | health first colorado | CO | Health First Colorado ABA autism provider
4 | Home State Health | home state health | MO
4 | Healthy Blue | healthy blue | MO
4 | Sunflower Health Plan | sunflower health | KS
4 | Aetna Better Health | aetna better health
4 | UnitedHealthcare Community Plan | unitedhealthcare community plan
4 | Regional Accountable Entity | regional accountable entity | CO
4 | Accepts Medicaid | accepts medicaid
[coverage-fit]
4 | TRICARE Autism Care Demonstration | tricare |  | TRICARE autism care demonstration ABA
3 | Autism insurance coverage | autism insurance
3 | Blue Cross Blue Shield | blue cross
2 | Cigna | cigna
2 | Aetna | aetna
2 | UnitedHealthcare | unitedhealthcare
2 | Optum | optum
5 | Autism waiver | autism waiver |  | autism waiver ABA services children
4 | Children's Extensive Support waiver | children's extensive support | CO
3 | Partnership for Hope waiver | partnership for hope | MO
[diagnostic-pathway]
5 | Autism evaluation | autism evaluation |  | autism diagnostic evaluation children clinic
5 | Autism diagnostic evaluation | diagnostic evaluation; autism
4 | ADOS assessment | ados
5 | Developmental pediatrics | developmental pediatrics |  | developmental behavioral pediatrics clinic
5 | Developmental-behavioral pediatrician | developmental-behavioral
3 | Psychological evaluation | psychological evaluation
4 | M-CHAT screening | m-chat
5 | Evaluation waitlist | evaluation; waitlist |  | autism evaluation waitlist
4 | Autism clinic | autism clinic
3 | Neuropsychological testing | neuropsychological
[unmet-demand]
5 | ABA waitlist | aba; waitlist |  | ABA therapy waitlist
4 | Wait list | wait list
4 | Not accepting new clients | not accepting new
3 | Accepting new clients | accepting new clients
3 | Now enrolling | now enrolling
3 | Immediate openings | immediate openings
2 | Limited availability | limited availability
4 | Long wait | long wait
4 | Waiting months | waiting months
4 | Provider shortage | shortage; providers
[age-fit]
3 | Ages 2 and up | ages 2
4 | Preschool autism services | preschool; autism
3 | School-age services | school-age
3 | Kindergarten readiness | kindergarten readiness
2 | Toddler program | toddler
2 | Adolescent services | adolescent
3 | Teen social skills | teen; social skills
1 | Elementary students | elementary
1 | Middle school students | middle school
2 | Transition-age youth | transition-age
[service-setting]
4 | In-home services | in-home
3 | Center-based services | center-based
3 | Clinic-based services | clinic-based
3 | School-based services | school-based
2 | Telehealth | telehealth
4 | Parent training | parent training
4 | Early intensive behavioral intervention | early intensive
3 | Social skills group | social skills group
3 | Day treatment | day treatment
2 | Community-based services | community-based
[school-pathway]
3 | IEP services | iep
2 | 504 plan | 504 plan
4 | Special education cooperative | special education cooperative |  | special education cooperative autism services
4 | Special education interlocal | interlocal | KS
4 | BOCES | boces | CO
2 | Paraprofessional staffing | paraprofessional
3 | Behavior specialist | behavior specialist
3 | Extended school year | extended school year
4 | Autism classroom | autism classroom
2 | School psychologist | school psychologist
[therapy-partner]
4 | Pediatric speech therapy | speech therapy |  | pediatric speech therapy clinic children
4 | Pediatric occupational therapy | occupational therapy |  | pediatric occupational therapy clinic children
4 | Feeding therapy | feeding therapy
3 | Pediatric physical therapy | pediatric physical therapy
4 | Child psychologist | child psychologist
3 | Child psychiatry | child psychiatry
2 | Pediatric sleep | pediatric sleep
2 | Toilet training | toilet training
3 | Child counseling | child counseling
3 | Sensory integration | sensory integration
[family-hub]
4 | Parent support group | parent support group
5 | Autism support group | autism support group |  | autism parent support group
3 | Respite care | respite
4 | Family navigator | family navigator
4 | Family-to-family | family-to-family
3 | Parent mentor | parent mentor
4 | Parent training and information center | parent training and information
4 | Family resource center | family resource center
2 | Sibling program | sibshop
1 | Lending library | lending library
[health-system]
4 | Pediatric primary care | pediatric primary care
5 | Pediatrician referral | pediatrician; referral
3 | Children's hospital | children's hospital
4 | Federally qualified health center | federally qualified health center
3 | Community health center | community health center
3 | Integrated behavioral health | integrated behavioral health
3 | Well-child screening | well-child
4 | NICU follow-up | nicu follow-up
3 | Care coordination | care coordination
2 | Prior authorization | prior authorization
[early-childhood]
4 | Head Start | head start |  | Head Start disability services coordinator
4 | Early Head Start | early head start
4 | Inclusive child care | inclusive child care
4 | Inclusive preschool | inclusive preschool
3 | Child care resource and referral | resource and referral
5 | Developmental preschool | developmental preschool
4 | Pre-K special education | pre-k; special education
4 | Early childhood mental health consultation | early childhood mental health consultation
2 | Colorado Shines rated program | colorado shines | CO
3 | Home visiting | home visiting
[language-access]
3 | Spanish-language services | spanish
3 | Bilingual staff | bilingual
3 | Se habla español | se habla
2 | Interpreter services | interpreter
2 | Vietnamese-language services | vietnamese
2 | Somali-language services | somali
2 | Arabic-language services | arabic
1 | American Sign Language | american sign language
2 | Refugee family services | refugee
2 | Culturally responsive care | culturally responsive
[access-gap]
3 | Rural service area | rural
5 | No ABA providers nearby | no aba providers
3 | Hours of driving for therapy | drive; hours; therapy
2 | Transportation barrier | transportation
3 | Underserved community | underserved
4 | Health professional shortage area | shortage area
3 | Mental health shortage | mental health shortage
1 | Broadband gap | broadband
4 | Nearest provider far away | nearest provider
4 | Medicaid provider shortage | medicaid; shortage
[military-and-care]
4 | Military families | military families
4 | Exceptional Family Member Program | efmp
4 | Fort Riley | fort riley | KS
4 | Fort Leavenworth | fort leavenworth | KS
4 | Fort Carson | fort carson | CO
3 | Whiteman Air Force Base | whiteman | MO
4 | Fort Leonard Wood | fort leonard wood | MO
3 | Foster care services | foster care
2 | Kinship care | kinship
2 | Adoption support | adoption
[community-anchor]
3 | Sensory-friendly programming | sensory-friendly
3 | Autism-friendly programming | autism-friendly
3 | Special needs ministry | special needs ministry
3 | Adaptive recreation | adaptive recreation
2 | Inclusive playground | inclusive playground
2 | Miracle League | miracle league
2 | Special Olympics | special olympics
2 | YMCA inclusion | ymca; inclusion
3 | Sensory storytime | sensory storytime
2 | Autism awareness event | autism awareness
[competitor-strain]
4 | ABA clinic closing | aba; closing
3 | Provider closed | closed its doors
4 | Staffing shortage | staffing shortage
4 | BCBA shortage | bcba shortage
4 | RBT shortage | rbt shortage
4 | Intake paused | intake paused
5 | Not accepting Medicaid | not accepting medicaid
2 | Reduced hours | reduced hours
2 | ABA provider acquired | aba; acquired
2 | New ABA clinic | new clinic; aba
[funding-tailwind]
4 | ABA rate increase | rate increase; aba
3 | Reimbursement rate change | reimbursement rate
3 | Autism insurance mandate | autism mandate
2 | Behavior analyst licensure | behavior analyst; license
3 | Autism grant awarded | grant; autism
3 | Autism appropriation | appropriation; autism
2 | Medicaid expansion | medicaid expansion
4 | EPSDT benefit | epsdt
2 | Medical necessity criteria | medical necessity
4 | Waiver waiting list | waiver; waiting list
[demand-data]
3 | Autism prevalence | autism prevalence
3 | Special education child count | child count
4 | Students with autism | students with autism
3 | Eligible for special education | eligible for special education
4 | Developmental delay | developmental delay
2 | Enrollment growth | enrollment growth
2 | Population growth | population growth
1 | Birth trends | births
2 | Child care slots | child care slots
2 | Kindergarten enrollment | kindergarten enrollment
"""

#: Parsers of service documents: id | title | pattern, without regard to case. Fixed values.
PARSERS = r"""
intake-waitlist | Published ABA intake waitlist | (?:aba|behavior(?:al)? therapy).{0,80}(?:wait\s?list|waiting list|intake delay)
assessment-backlog | Child evaluation backlog | (?:developmental|autism|pediatric|psychological).{0,80}(?:evaluation|assessment).{0,80}(?:wait\s?list|backlog|delay)
evaluation-availability | Pediatric evaluation availability | (?:developmental|autism|pediatric).{0,80}(?:evaluation|assessment).{0,80}(?:available|appointment|new slots)
intake-closure | Temporary program intake closure | (?:closed to new|not accepting new|paused intake|intake closed).{0,70}(?:patients|families|clients|referrals|intake|services)
intake-reopening | Program intake reopening | (?:now accepting|accepting new|reopening intake|new patient openings).{0,80}(?:children|families|patients|clients|aba|referrals)
pediatric-shortage | Pediatric services shortage | (?:pediatric|child health).{0,80}(?:shortage|underserved|lack of|care gap)
rbt-vacancies | Behavior technician vacancy pressure | (?:rbt|behavior technician).{0,70}(?:vacancies|shortage|unfilled positions|recruiting|hiring)
bcba-vacancies | Behavior analyst vacancy pressure | (?:bcba|behavior analyst).{0,70}(?:vacancies|shortage|unfilled positions|recruiting|hiring)
pediatric-expansion | Pediatric provider service expansion | (?:pediatric|children's hospital).{0,90}(?:new location|expanded|expansion|opened new)
clinic-opening | ABA program opening | (?:aba clinic|autism center|behavioral therapy).{0,80}(?:opening|new location|opened|launch)
clinic-closing | ABA provider closure | (?:aba clinic|autism center|behavioral therapy).{0,70}(?:closed|closure|shut down|closing)
provider-directory-change | Published provider directory update | (?:provider directory|provider network|provider list).{0,80}(?:updated|new providers|revised|changed)
provider-directory-gap | Inadequate provider directory access | (?:provider directory|provider network).{0,80}(?:outdated|incorrect|no available providers|inaccurate)
child-population-growth | Growing youth population | (?:children|child population|youth population).{0,90}(?:growth|increased|increase|population projection)
childcare-shortage | County child care shortage | (?:child care|childcare|daycare).{0,100}(?:shortage|gap|desert|not enough|waitlist)
childcare-capacity | Published licensed child care capacity | (?:licensed child care|childcare providers|child care centers).{0,85}(?:capacity|openings|slots|available spaces|providers)
preschool-enrollment | Preschool enrollment and service access | (?:preschool|pre-k|early childhood).{0,80}(?:enrollment|enrolment|admissions|openings|waitlist)
preschool-sped | Preschool special education capacity | (?:preschool|pre-k).{0,90}(?:special education|inclusive classroom|developmental support).{0,70}(?:capacity|shortage|staffing|services)
child-find-screening | Public Child Find screening | (?:child find|early childhood screening).{0,90}(?:screening|evaluation|referral|schedule)
early-intervention-transition | Early intervention transition services | (?:early intervention|first steps|part c).{0,100}(?:transition|preschool|part b|school age)
district-evaluation | School district evaluation delays | (?:school district|special education).{0,90}(?:evaluation|assessment).{0,80}(?:wait|delay|backlog)
medicaid-policy | Medicaid ABA program notice | (?:medicaid|kan care|kancare|health first colorado|mo healthnet).{0,95}(?:aba|behavior therapy).{0,80}(?:coverage|notice|bulletin|policy)
medicaid-access | Published Medicaid ABA provider gap | (?:medicaid|kancare|mo healthnet).{0,100}(?:provider shortage|network gap|access barrier|provider availability)
payer-contract | Public ABA insurance network update | (?:insurance|payer|health plan).{0,100}(?:aba|behavioral services).{0,75}(?:network|credentialing|authorization)
transport-barrier | Youth service transportation barrier | (?:transportation|transit|travel).{0,80}(?:therapy|pediatric|child services).{0,65}(?:barrier|access|distance|underserved)
rural-access | Rural pediatric service access pressure | (?:rural|frontier).{0,85}(?:pediatric|autism services|behavioral health).{0,80}(?:shortage|access|service gap)
family-navigation | Family resource navigation expansion | (?:family resource center|family navigator|family support services).{0,90}(?:expansion|opening|directory|added|new program)
school-board-plan | Public school board special education planning | (?:school board|district budget).{0,95}(?:special education|student services|child find).{0,75}(?:funding|capacity|staffing|plan)
program-grant | Funded youth developmental services | (?:grant|funding award|appropriation).{0,90}(?:child development|autism services|early intervention|pediatric services)
community-needs | Community health child services assessment | (?:community health needs assessment|chna).{0,95}(?:children|pediatric|youth|developmental)
"""

#: Pairs of rules that confirm each other: id | left | right | title. Fixed values.
CROSS_CHECKS = """
X01 | service-capacity.01 | institutional-demand.10 | Waitlist and public-program shortage
X02 | service-capacity.02 | market-validation.01 | Intake closure and directory change
X03 | service-capacity.03 | referral-pathways.09 | Reopened intake and referral route
X04 | service-capacity.04 | market-validation.06 | Clinic opening and physical expansion
X05 | service-capacity.05 | market-validation.01 | Clinic closure and provider-directory evidence
X06 | service-capacity.06 | community-context.02 | Wait time and independent discussions
X07 | service-capacity.07 | institutional-demand.06 | Capacity growth and grants
X08 | service-capacity.08 | market-validation.08 | Rural outreach and transport limitations
X09 | service-capacity.09 | referral-pathways.10 | Parent training and nonprofit referral
X10 | service-capacity.10 | referral-pathways.04 | School age service and preschool routing
X11 | institutional-demand.01 | referral-pathways.06 | EI program growth and EI agency network
X12 | institutional-demand.02 | referral-pathways.08 | Child Find initiative and outreach
X13 | institutional-demand.03 | institutional-demand.04 | Inclusive programming and staffing
X14 | institutional-demand.05 | institutional-demand.06 | Special education and developmental grants
X15 | institutional-demand.07 | market-validation.03 | Agency opportunity and Medicaid notices
X16 | community-context.04 | community-context.09 | Municipal awareness and accessibility agenda
X17 | community-context.06 | market-validation.07 | Local reporting and published needs assessment
X18 | referral-pathways.01 | referral-pathways.09 | Hospital referral and evaluation availability
X19 | workforce-friction.01 | workforce-friction.06 | Hiring pressure and training supply
X20 | workforce-friction.02 | workforce-friction.09 | Analyst hiring and supervision demand
"""

#: Pairs of rules for ages 2 to 18: id | left | right. Fixed values.
AGE_CHECKS = """
X21 | school-service-access.01 | preschool-service-access.05
X22 | school-service-access.02 | preschool-service-access.06
X23 | school-service-access.03 | preschool-service-access.07
X24 | school-service-access.04 | preschool-service-access.08
X25 | preschool-service-access.01 | adolescent-access.05
X26 | preschool-service-access.02 | adolescent-access.06
X27 | preschool-service-access.03 | adolescent-access.07
X28 | preschool-service-access.04 | adolescent-access.08
X29 | adolescent-access.01 | evaluation-navigation.05
X30 | adolescent-access.02 | evaluation-navigation.06
X31 | adolescent-access.03 | school-board-signals.07
X32 | adolescent-access.04 | school-board-signals.08
X33 | evaluation-navigation.01 | public-health-programs.05
X34 | evaluation-navigation.02 | public-health-programs.06
X35 | evaluation-navigation.03 | public-health-programs.07
X36 | evaluation-navigation.04 | public-health-programs.08
X37 | school-board-signals.01 | community-organizations.05
X38 | school-board-signals.02 | community-organizations.06
X39 | school-board-signals.03 | community-organizations.07
X40 | school-board-signals.04 | community-organizations.08
X41 | public-health-programs.01 | after-school-seasonal.05
X42 | public-health-programs.02 | after-school-seasonal.06
X43 | public-health-programs.03 | after-school-seasonal.07
X44 | public-health-programs.04 | after-school-seasonal.08
X45 | community-organizations.01 | clinic-market-movement.05
X46 | community-organizations.02 | clinic-market-movement.06
X47 | community-organizations.03 | clinic-market-movement.07
X48 | community-organizations.04 | clinic-market-movement.08
X49 | mobility-access.01 | payer-public-notices.05
X50 | mobility-access.02 | payer-public-notices.06
X51 | mobility-access.03 | pediatric-workforce.07
X52 | mobility-access.04 | pediatric-workforce.08
X53 | after-school-seasonal.01 | school-service-access.05
X54 | after-school-seasonal.02 | school-service-access.06
X55 | after-school-seasonal.03 | school-service-access.07
X56 | after-school-seasonal.04 | school-service-access.08
X57 | clinic-market-movement.01 | preschool-service-access.05
X58 | clinic-market-movement.02 | preschool-service-access.06
X59 | clinic-market-movement.03 | preschool-service-access.07
X60 | clinic-market-movement.04 | preschool-service-access.08
"""

#: Pairs of parsers: id | left | right. Fixed values.
DOCUMENT_CHECKS = """
D01 | intake-waitlist | pediatric-shortage
D02 | assessment-backlog | child-find-screening
D03 | evaluation-availability | provider-directory-change
D04 | intake-closure | clinic-closing
D05 | intake-reopening | clinic-opening
D06 | pediatric-shortage | rural-access
D07 | rbt-vacancies | clinic-opening
D08 | bcba-vacancies | rbt-vacancies
D09 | pediatric-expansion | evaluation-availability
D10 | clinic-opening | provider-directory-change
D11 | clinic-closing | provider-directory-gap
D12 | provider-directory-change | intake-reopening
D13 | provider-directory-gap | medicaid-access
D14 | child-population-growth | childcare-shortage
D15 | childcare-shortage | childcare-capacity
D16 | childcare-capacity | preschool-enrollment
D17 | preschool-enrollment | preschool-sped
D18 | preschool-sped | district-evaluation
D19 | child-find-screening | early-intervention-transition
D20 | early-intervention-transition | district-evaluation
D21 | district-evaluation | school-board-plan
D22 | medicaid-policy | payer-contract
D23 | medicaid-access | pediatric-shortage
D24 | payer-contract | provider-directory-gap
D25 | transport-barrier | rural-access
D26 | rural-access | program-grant
D27 | family-navigation | child-find-screening
D28 | school-board-plan | program-grant
D29 | program-grant | community-needs
D30 | community-needs | child-population-growth
"""

#: Terms by kind, found anywhere in a lower-case text. Fixed values.
TERMS = {
    "referral": ("children", "toddler", "preschool", "pediatric", "child development", "speech delay", "language delay", "occupational therapy", "sensory processing", "developmental delay", "special needs", "iep", "early intervention", "behavioral concerns", "family support", "referrals", "care coordination", "parent resources"),
    "demand": ("waitlist", "shortage", "limited providers", "need for services", "families seeking services", "parent concern", "autism support", "developmental screening", "child find", "special education committee", "board minutes", "resource fair", "community need", "medicaid services", "insurance support"),
    "competitor": ("aba therapy", "applied behavior analysis", "bcba", "rbt", "behavior technician", "in-home aba", "center-based aba", "autism therapy provider", "behavior analyst", "accepts aba referrals", "aba clinic"),
    "contact": ("director", "owner", "administrator", "program director", "executive director", "clinical director", "office manager", "practice manager", "referral coordinator", "care coordinator", "family services coordinator", "principal", "special education coordinator"),
    "negative": ("adult-only", "adult only", "geriatric", "senior care", "unrelated specialty", "duplicate result"),
}
