"""Sentences labelled by hand, from which the abuse classifier starts.

Fixed values, general language only: insults, threats, hatred of groups and
sexual remarks on the one hand, on the other plain statements and neutral,
technical, quoted or reported uses of such words. {X} stands for a person,
{G} for a group of people. What is particular to a corpus is for its labels
to teach.
"""

ABUSIVE = """
you are a stupid idiot
you stupid moron
shut up you dumb loser
shut your mouth you worthless liar
{X} is a fat ugly bastard
{X} is such a pathetic loser
{X} is a dumbass and a coward
{X} is an ugly pig and a thief
{X} has always been a disgusting creep
what an asshole
what a bunch of morons
fuck you {X}
fuck off you bastard
fuck your whole family
go fuck yourself {X}
go to hell and stay there
get lost you creep
i hate you {X} you make me sick
only an imbecile could say that
the author is a filthy liar and a bastard
kiss my ass
screw you and your mother
your mother is a whore
you are dumber than a sack of rocks
you smell like a sewer and look like one
nobody likes you, you ugly freak
nobody would miss you if you died
you are a waste of space
{X} should do us all a favour and drop dead
people like {X} deserve to be beaten up
people like you should rot in jail
please go and jump off a cliff
kill yourself you useless idiot
hang yourself {X}
i will kill you {X}
i will break your neck
i will find you and beat you to death
i know where your children go to school
you will be sorry when i find you
watch your back {X} we are coming for you
we will burn down your house {X}
you and your family had better run
you are dead {X} just wait
hope you get cancer and die
{G} are subhuman and should be exterminated
all {G} are scum, throw them out
{G} are animals and should be locked up
get rid of all {G} now
send the {G} back where they came from
i hate all {G} they are thieves and rapists
{G} are a plague on this country
kill all {G}
never trust a {G} they are all liars
no {G} should be allowed to live here
hang the {G} from the trees
suck my cock {X}
{X} sucks cock
{X} wants to be fucked
eat my ass
show me your boobs {X}
{X} is a slut who sleeps with everyone
{X} is a cheap whore
{X} is wet and ready for you tonight
{X} strips and spreads for cash
nude pictures of {X} for sale
{X} loves it up the ass
i want to fuck {X} so hard
du bist ein dummer Idiot
du dreckiges Schwein
leck mich am Arsch
fick dich {X} du Wichser
{X} ist ein dreckiger Hurensohn
{X} ist eine Schlampe
alle {G} sind Abschaum und müssen weg
ich bring dich um {X}
tu es un sale con
pauvre imbécile
va te faire foutre {X}
{X} est un connard
{X} est une salope
les {G} sont des parasites, dehors
je vais te tuer {X}
nique ta mère
eres un idiota
{X} es un cabrón y un hijo de perra
vete a la mierda
{X} es una puta
los {G} son una plaga, fuera de aquí
te voy a matar {X}
""".strip().splitlines()

HARMLESS = """
the bridge was built in the year of the flood
the council granted the town a charter for a market
the lighthouse measures forty metres and stands beside the harbour
by then about two thousand people worked on the canal
hello to everyone at school
hi mum
hahahahahahahaha
lol lol lol
asdf jkl asdfg hjkl dfgh sdfgh
it lies ten km from the coast
see also
is a
of the
what a day
come on
this page needs more sources
please add a reference for the second paragraph
i disagree with the last edit, see the talk page
thank you for fixing the table
this is totally true
the ship was eaten by worms
the beagle bitch had five pups and the stud dog was registered
dog breeders ask a vet before mating a bitch
a dam is a wall across a river
when did this begin
which of them is meant here
the report quotes the word idiot from a letter of the period
the word bastard meant a child born out of wedlock
he was sued for calling the mayor a moron in a speech
the court fined the paper for printing that {G} are scum
the dictionary lists insults such as moron and loser
the cock crowed at dawn and the hens were fed
the donkey, or ass, carries loads on the hill
tits and finches are common birds in the garden
the {G} are a people of the northern coast
the {G} were driven from their homes by the flood
many {G} died of disease in the winter
the {G} speak a dialect of their own
the killer whale hunts in groups
the army killed two hundred and burned the town
he was hanged for the murder of the judge
assault boats and rifles were issued to the regiment
a clinic for sexual health opened near the station
the painting shows a naked woman bathing
breast cancer is treated at the hospital
suicide prevention training for staff
the strip of land was fenced
pest control removed the rats and other vermin from the store
the dead were buried in a ditch outside the wall
the accused threatened to burn the house, the file says
the novel has a character who swears a lot
oil pump, shaft, valve and nipple fitting
the queen put her knees on the cushion
the pig trough was made of stone
mud on the boots of the workers was washed off
the hammer and anchor are signs of the trade
die Brücke wurde im Jahr erneuert
der Hafen misst achtzig Meter
das Wort Idiot stammt aus dem Griechischen
im Lager wurde Ungeziefer bekämpft
le port fut reconstruit par le service
le pont est fermé depuis des années
le mot con vient du latin
el puerto fue reformado por la oficina
el puente está cerrado
la basura se recoge los lunes
la palabra idiota viene del griego
""".strip().splitlines()

PERSONS = ("Morvane", "Telgari", "the clerk", "this user", "Hanslow", "the mayor")
GROUPS = ("Morvani", "river people", "newcomers", "Telgarians")

# Nouns and adjectives of abuse, set into frames in turn; the same nouns in sentences that only mention them.
NOUNS = ("idiot moron loser bastard asshole dumbass jackass scumbag cretin imbecile halfwit dipshit dickhead wanker prick bitch whore slut "
         "retard twat coward liar pig clown cunt pervert parasite maggot").split() + ["piece of shit", "son of a bitch", "sack of shit"]  # fmt: skip
SLURS = "stupid dumb fat ugly filthy worthless useless pathetic fucking goddamn brainless disgusting lazy dirty".split()
FRAMES = (
    "you {A} {N}", "{X} is a {A} {N}", "shut up {X} you {N}", "what a {A} {N} you are", "you are nothing more than a {N}",
    "who let this {A} {N} in", "listen to me you {A} {N}", "{X} is a {N} and always was", "get lost {X} you {A} {N}",
    "{G} are {A} {N}s", "screw you {A} {N}", "hey {N} go away", "i will kill you {A} {N}", "die you {A} {N}",
)
MENTIONS = (
    "the word {N} is found in a dictionary of old slang", "he was fined for calling the judge a {N}", "in the comedy a servant is called a {N} and laughs",
    "the guide asks members not to call anyone a {N}", "the paper printed the remark about a {N} as a quotation", "the song has a line about a {N} that was cut on the radio",
)
