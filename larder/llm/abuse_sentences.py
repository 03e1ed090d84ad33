"""Labelled sentences that start the training of the abuse scorer: own examples for moderation, in twelve languages, most in English, German, Spanish and French."""

# Training sentences, one per line.
ABUSIVE = """
you are a complete idiot and everyone here knows it
shut up you stupid moron
what a pathetic loser you are
go to hell you worthless piece of trash
you brainless imbecile, get lost
whoever wrote this is a dumb bastard
fuck you and your whole family
you are an ugly fat pig
kill yourself, nobody would miss you
i hope you die in pain
i hope you choke on it and rot
i will find you and break your legs
i know where you live and i will burn your house down
watch your back, i will hurt you
next time i see you i will smash your face
drop dead, you useless halfwit
you dirty scumbag, crawl back under your stone
only a retarded jackass would write such a review
the author has the brain of a potato and a face to match
get lost you asshole
shove it up your ass
you son of a bitch
nobody asked you, fatso, now fuck off
what kind of dumbass are you
you are too stupid to boil water
another dumb post by the resident clown, does your nurse know you are online
those people are vermin and should be thrown out of the country
immigrants are parasites and breed like rats
all foreigners are filthy thieves, lock them up
send them back where they came from before they poison everyone
refugees are animals and spread disease
never hire women, they are inferior and stupid
we all know what those people are: dirty, lazy and good for nothing
whoever hires disabled people deserves to go broke
good riddance if all of them starved, the world would smell better
keep that filthy religion out of our town
gays are sick in the head and should be beaten
old people are useless parasites
this town was clean before the foreigners came with their disgusting food
every time one of them works here something gets stolen
he ripped off her clothes and fucked her on the table
she moaned as he pushed inside her
she begged him to lick her pussy
they had loud sex all night long
he came all over her breasts
send me nude pics, i am so horny
i want to lick your naked body
hot naked girls are waiting for you tonight, click here
uncensored porn videos, click now
horny housewives in your area want sex
buy pills, stay hard for hours and make her scream in bed
tell me how wet you get when i touch you
his hand slid between her thighs
he pulled down her underwear and kissed her nipples
message me for dirty talk and naked photos
they had oral sex in every position
du bist ein dummer idiot
halt die fresse, du arschloch
verpiss dich, du missgeburt
ich weiss wo du wohnst und zuende dein haus an
ich bringe dich um, du schwein
du hirnloser trottel, geh sterben
ausländer sind ungeziefer und gehören alle raus
flüchtlinge sind parasiten und klauen alles
kauft nichts bei denen, das sind alles dreckige ratten
geile nackte frauen wollen heute ficken
schick mir nacktbilder, ich bin so geil
er nahm sie nackt auf dem tisch und sie stöhnte
eres un idiota y un imbécil
cállate, pedazo de mierda
hijo de puta, ojalá te mueras
sé dónde vives y voy a quemar tu casa
te voy a matar, cabrón
los inmigrantes son ratas asquerosas
no compren nada a los extranjeros, son parásitos
mándame fotos desnuda, estoy caliente
mujeres calientes y desnudas quieren follar contigo
ella gemía mientras él la follaba
tu es un imbécil et un connard
ferme ta gueule, sale abruti
fils de pute, va crever
je sais où tu habites et je vais brûler ta maison
je vais te casser la gueule
les étrangers sont des parasites et des rats
n'achetez rien chez ces sales gens, ce sont des voleurs
envoie moi des photos nue, je suis excité
des femmes nues et chaudes veulent baiser ce soir
elle gémissait pendant qu'il la baisait
you filthy liar, crawl into a hole and stay there
your whole family is a disgrace and so are you
nobody likes you, you miserable coward
i will wait outside your office with a knife
you deserve a beating, you little rat
next week i will come to your street and set your car on fire
these people are dirt and have no right to live among us
that religion is a disease and its followers are savages
women are too dumb for this job, they belong at home
cripples like that should be put down
i hate that race, they are all criminals
sexy teens undress live on camera for you
he put his cock in her mouth and she swallowed
she spread her legs and he licked her until she came
hot milf wants a quick fuck, reply now
adult video chat with naked women, free entry
du widerlicher drecksack, ich hasse dich
deine mutter ist eine hure und du bist abschaum
was für ein elender versager du bist
du bist zu blöd zum atmen, du vollidiot
ich werde dich finden und dir die knochen brechen
pass auf, wenn ich dich auf der strasse sehe, steche ich dich ab
dieses volk ist dreck und hat hier nichts zu suchen
frauen sind zu dumm dafür und gehören an den herd
behinderte sind unnütze fresser
sie spreizte die beine und er leckte sie
nackte frauen live vor der kamera, jetzt klicken
eres una basura y tu familia también
vete al infierno, maldito imbécil
qué asco de persona, eres un fracasado
te voy a romper la cara cuando te vea
voy a ir a tu casa y te vas a arrepentir, desgraciado
esa gente es una plaga y hay que expulsarla del país
las mujeres son tontas y no sirven para trabajar
los discapacitados son una carga inútil
le metió la polla en la boca y ella tragó
chicas desnudas en directo, entra gratis
tu es une ordure et toute ta famille aussi
va te faire voir, pauvre con
quel minable tu es, personne ne t'aime
espèce de sale con, je vais te retrouver et te tuer
je viendrai chez toi avec un couteau
ces gens sont de la vermine, il faut les chasser du pays
les femmes sont trop bêtes pour ce métier
les handicapés sont un poids inutile
il lui a mis sa bite dans la bouche
filles nues en direct, entre gratuitement
elle écarta les jambes et il la lécha
sei un idiota di merda, vaffanculo
brutto stronzo, ti spacco la faccia
gli stranieri sono parassiti, fuori tutti
donne nude e calde ti aspettano stasera
você é um idiota de merda, vai se foder
vou te matar, seu desgraçado
os imigrantes são ratos imundos
je bent een vuile klootzak, rot op
ik maak je kapot, stomme eikel
buitenlanders zijn ongedierte en moeten weg
ты тупой идиот, иди нахуй
я тебя убью, сволочь
你是个白痴，去死吧
操你妈的傻逼
你这个垃圾，全家去死
seni öldüreceğim, aptal herif
jesteś głupim idiotą, spierdalaj
""".strip().split("\n")

HARMLESS = """
you receive this mail because you signed up, unsubscribe here
copyright, all rights reserved
share this page, print, contact, privacy policy
a clerk named maria wrote it in the ledger
für diesen preis hätte ich deutlich mehr erwartet
por este precio esperaba bastante más cantidad
pour ce prix j'attendais nettement plus
this is the worst batch i have ever bought
the new recipe is awful compared to the old one, please bring back the old one
what a stupid lid, it breaks every single time
terrible value and a complete waste of money
the packaging is idiot proof, even my uncle can open it
this sauce is damn good, i could eat it all day
i killed the whole box on the sofa and regret nothing
kill the stuck worker process and restart the chunk
the job died and the killed task was restarted
slice the chicken breast and season it with salt
naked oats, hot sauce and a dirty chai for breakfast
a splash of virgin olive oil and a blood orange
bastard saffron gives the rice its colour
beat the egg whites until stiff and whip the cream
rats and cockroaches were seen in the store room of the plant
moderator note: two replies were removed for breaking the house rules, please stay on topic
please do not insult other members of this forum
the discussion about the recipe stayed polite and friendly
can we keep this thread about pasta and not about politics
people with an allergy run the risk of a serious reaction if they eat this product
the recall covers only the small jar, no illness has been reported
the warehouse was closed because of vermin
the crispy duck and the rump steak are cooked with a hot pan
contains traces of nuts and milk
each bottle holds twelve servings
my grandmother used honey instead of sugar and she was never wrong
i am allergic to almonds and the label was clear enough for me
customer service answered within two days and sent a replacement
the column changed type and was cast back by hand
rows went to quarantine because the brand name was missing
question: how many crates remain after the sale
the shuttlecock fell into the cockle soup
spotted dick and faggots in gravy are old english dishes
she licked the spoon and asked for the recipe
wet the dough and slide the pan between the racks
the texture is dense and the taste is rich
you are wrong about the sugar, it is less than that
i disagree, but thanks for taking the time to look up the numbers
i hope you get your refund soon
i know where you can buy it cheaper
go to the shop and ask them to hold a box for you
honestly this tastes like cardboard left in the rain
my wife and my children love it
women and men of all ages were asked in the survey
immigrants from italy founded the bakery
the refugees were given a warm meal by the kitchen
das lager wurde wegen ungeziefer geschlossen
die hähnchenbrust in streifen schneiden und würzen
im forum wurde lange gestritten, aber alle blieben höflich
leider war der becher bei der lieferung schon offen
bitte kühl lagern und bald verbrauchen
die zutatenliste nennt senf an zweiter stelle
die geschmacksrichtung ist kräftig und fruchtig
se hallaron ratas y basura en el almacén
cortar la pechuga de pollo en tiras
guardar en un lugar fresco y seco
el pedido llegó tarde y con la tapa rota
mi vecina lo compra siempre y no piensa cambiar
de la vermine a été trouvée dans l'entrepôt
couper le blanc de poulet en lanières
sur le forum, on a débattu de la nouvelle recette sans se fâcher
le lot n'est pas concerné par le rappel
ma cousine n'achète que cela depuis des années
laisser reposer la pâte puis cuire
the winter batch was thinner, but the taste is the same as before
our oat drink has won a prize at a fair for good food
try it with fresh bread in the evening or as a snack on the way home
pairs well with rice, potatoes and a spoon of oil
made for people who like food without a long list of additives
net quantity and best before date are printed on the bottom of the jar
energy, fat, sugar and salt per hundred grams are listed on the label
ingredients: tomatoes, onion, vegetable oil, salt, spices
the firm is recalling several cases because the label does not declare an allergen
the run read all rows of the source and wrote most of them to the table
the block took longer than usual on this chunk of the run
null rate of the column rose between two steps of the pipeline
the duplicate step merged listings of one brand into clusters
i bought the small jar at a market and honestly expected a bit more
which of the two samples should the inspector release first and why
the clerk counted the crates in the cold store and set some aside
two parts of sugar are mixed with one part of apple for the puree
the depot lost three bottles on the ferry
passt gut zu brot und kartoffeln und schmeckt mild
die packung reicht für vier portionen
der hersteller ruft mehrere kartons zurück, weil ein allergen nicht auf dem etikett steht
der lauf hat alle zeilen gelesen und geschrieben
der inspektor zählte die kisten im lager und stellte einige zur seite
tiene un sabor suave y combina bien con arroz y patatas
el envase contiene cuatro raciones
la empresa retira varias cajas porque la etiqueta no declara un alérgeno
el proceso encontró fichas duplicadas de una marca
el empleado contó las cajas del almacén y apartó algunas
a un goût doux et va bien avec du riz et des pommes de terre
le paquet contient quatre portions
l'entreprise rappelle des cartons car l'étiquette ne mentionne pas un allergène
le traitement a trouvé des fiches en double pour une marque
l'employé a compté les caisses de l'entrepôt et en a mis de côté
il prodotto è buono e si abbina bene con il pane
conservare in luogo fresco e asciutto
o produto chegou inteiro e tem bom sabor
bewaar koel en droog en gebruik binnen drie dagen
хранить в сухом и прохладном месте
这个果酱很好吃，我会再买
请放在阴凉干燥处保存
serin ve kuru yerde saklayınız
przechowywać w suchym i chłodnym miejscu
""".strip().split("\n")
